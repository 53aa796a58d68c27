"""Stored artefacts as Parquet: encodings with their configuration, query caches, packs, incremental truth."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import asdict, fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.operators.fde import Encoding, FdeConfig, Projection


def query_key(qid: Column, text: Column) -> Column:
    """SHA-1 of id and text."""
    return F.sha1(F.concat(F.coalesce(qid, F.lit("")), F.lit("||"), text))


def short_key(qid: Column, text: Column) -> Column:
    """The id, or for an empty one the first 16 digits of the text's MD5."""
    return F.coalesce(F.nullif(qid, F.lit("")), F.substring(F.md5(text), 1, 16))


def folder_name(dataset: str, model: str, cfg: FdeConfig) -> str:
    """Readable, and distinct for each configuration."""
    said = json.dumps([dataset, model, _plain(cfg)], sort_keys=True)
    readable = "-".join(re.sub("[^A-Za-z0-9.]+", "_", part) for part in (dataset, model))
    return f"{readable}-{hashlib.md5(said.encode()).hexdigest()[:10]}"


def _plain(cfg: FdeConfig) -> dict:
    return {k: getattr(v, "value", v) for k, v in asdict(cfg).items()}


def _config(said: dict) -> FdeConfig:
    kinds = {"encoding": Encoding, "projection": Projection}
    return FdeConfig(**{f.name: kinds.get(f.name, lambda v: v)(said[f.name]) for f in fields(FdeConfig) if f.name in said})


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table; None where there is none, or nothing that can be read as Parquet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def save_index(encodings: DataFrame, cfg: FdeConfig, path: str) -> None:
    """Encodings and all of the configuration; the row count, and that of rows of a wrong length, are taken from what was written."""
    spark = encodings.sparkSession
    encodings.write.mode("overwrite").parquet(f"{path}/fde")
    seen = spark.read.parquet(f"{path}/fde").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("fde") != cfg.length, F.lit(True))).alias("wrong")).first()
    spark.createDataFrame([(json.dumps(_plain(cfg)), seen.n, seen.wrong)], "config string, n long, wrong long").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str, n_documents: int | None = None) -> tuple[DataFrame, FdeConfig] | None:
    """The stored index; None where there is none, its size isn't ``n_documents`` or a row's length isn't the configuration's.

    The row of facts that was stored with the encodings is read, not the encodings.
    """
    facts, rows = read(spark, f"{path}/meta"), read(spark, f"{path}/fde")
    meta = facts.first() if facts is not None else None
    if meta is None or rows is None or meta.wrong or (n_documents is not None and meta.n != n_documents):
        return None
    return rows, _config(json.loads(meta.config))


def cached_queries(queries: DataFrame, cfg: FdeConfig, path: str, encode: Callable[[DataFrame, FdeConfig], DataFrame]) -> DataFrame:
    """qid, fde of all queries (qid, toks, and text where there is one): from the cache at ``path`` where it has them.

    A query is known by the SHA-1 of its id and text, or of its id and cloud, so one that changes is another. What the cache lacks, or has in
    another length than the index's, is encoded and appended. Of entries that two runs have both made one counts.
    """
    spark = queries.sparkSession
    said = F.col("text") if "text" in queries.columns else F.to_json("toks")
    keyed = queries.withColumn("key", query_key(F.col("qid").cast("string"), F.coalesce(said, F.lit(""))))
    old = read(spark, path)
    if old is None:
        missing = keyed
    else:
        missing = keyed.join(old.join(stale(old, cfg).select("key"), "key", "left_anti").select("key").distinct(), "key", "left_anti")
    # Texts of one key are equal, so are their clouds; repeated queries are encoded once.
    made = missing.dropDuplicates(["key"]).select("key", "toks")
    encode(made.withColumnRenamed("key", "qid"), cfg).select(F.col("qid").alias("key"), "fde").write.mode("append").parquet(path)
    known = spark.read.parquet(path).where(F.size("fde") == cfg.length).dropDuplicates(["key"])
    return keyed.select("qid", "key").join(known, "key").select("qid", "fde")


def stale(cached: DataFrame, cfg: FdeConfig) -> DataFrame:
    """Cached query encodings of another length than the index's."""
    return cached.where(F.size("fde") != cfg.length)


def write_lists(assigned: DataFrame, path: str) -> None:
    """Inverted lists, one folder each, so a probe reads its lists alone; a list's rows go to several files, not to one task."""
    assigned.write.mode("overwrite").partitionBy("list_id").parquet(path)


def write_tokens(tokens: DataFrame, path: str, partitions: int) -> None:
    """Token rows in order of document and token, by ranges of documents: a read of some documents skips most row groups."""
    tokens.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "tok_id").write.mode("overwrite").parquet(path)


def unseen(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """Queries that the stored truth lacks."""
    return queries.join(truth.select("qid").distinct(), "qid", "left_anti")


def extend_truth(truth: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """Stored truth and that of unseen queries, ranked again and cut to k. Scores have eight digits, as stored."""
    rows = truth.select("qid", "doc_id", "score").unionByName(new.select("qid", "doc_id", F.round("score", 8).alias("score")))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def append_truth(new: DataFrame, path: str) -> None:
    new.select("qid", "doc_id", F.round("score", 8).alias("score"), "rank").write.mode("append").parquet(path)
