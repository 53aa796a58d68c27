"""Whole plans: building an index, searching it, measuring the result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import ann, chamfer, fde, metrics, partial, rerank, store
from tesserae.operators.fde import FdeConfig
from tesserae.session import keep
from tesserae.sources import tables


@dataclass(frozen=True, kw_only=True)
class SearchConfig:
    """candidates: of the approximate stage; rerank_n: how many of them are rescored; nprobe 0: exhaustive.

    read_policy ``sketch`` rescores on the ``sketch_tokens`` longest tokens of a cloud; with ``exact_n`` the so many best of those are then
    rescored on whole clouds.
    """

    candidates: int = 100
    rerank_n: int = 50
    nprobe: int = 10
    read_policy: str = "full"
    sketch_tokens: int = 256
    exact_n: int = 0


def build(documents: DataFrame, cfg: FdeConfig, path: str, nlist: int, seed: int = 42) -> None:
    """Encodings, centroids and inverted lists of packed documents (doc_id, toks)."""
    spark = documents.sparkSession
    store.save_index(fde.encode_documents(documents, cfg), cfg, path)
    rows = spark.read.parquet(f"{path}/fde")
    share = ann.training_share(rows.count(), nlist)
    ann.train(rows, nlist, seed, share).write.mode("overwrite").parquet(f"{path}/centroids")
    store.write_lists(ann.assign(rows, spark.read.parquet(f"{path}/centroids")), f"{path}/lists")


def ensure(documents: DataFrame, cfg: FdeConfig, path: str, nlist: int, seed: int = 42) -> bool:
    """Builds the index unless the stored one is of this configuration and of as many documents; says whether it did."""
    found = store.load_index(documents.sparkSession, path, documents.count())
    if found and found[1] == cfg:
        return False
    build(documents, cfg, path, nlist, seed)
    return True


def candidates(spark: SparkSession, path: str, queries: DataFrame, cfg: SearchConfig, documents: DataFrame | None = None, made: FdeConfig | None = None, query_cache: str | None = None) -> DataFrame:
    """qid, doc_id, score, rank by the index, or by all encodings where nprobe is 0 or the lists or their centroids are missing.

    Where the encodings are missing too, or don't fit their configuration, documents (doc_id, toks) are encoded with ``made`` for this
    search; without those it is an error. ``query_cache``: where encoded queries are kept.
    """
    found = store.load_index(spark, path)
    if found is None and (documents is None or made is None):
        raise ValueError("the index is missing or doesn't fit its configuration: build it again")
    rows, used = found or (fde.encode_documents(documents, made), made)
    asked = store.cached_queries(queries, used, query_cache, fde.encode_queries) if query_cache else fde.encode_queries(queries, used)
    lists, centroids = (store.read(spark, f"{path}/{part}") if found and cfg.nprobe else None for part in ("lists", "centroids"))
    if lists is None or centroids is None:
        return fde.search(asked, rows, cfg.candidates)
    return ann.search(asked, lists, centroids, cfg.nprobe, cfg.candidates)


def search(spark: SparkSession, path: str, queries: DataFrame, documents: DataFrame, cfg: SearchConfig, made: FdeConfig | None = None, query_cache: str | None = None) -> DataFrame:
    """qid, doc_id, score, stage, rank: candidates, rescored on the tokens that the policy reads, then the tail."""
    clouds = documents if cfg.read_policy == "full" else documents.withColumn("toks", partial.half(F.col("toks"), cfg.read_policy, cfg.sketch_tokens))
    # Read twice, for the head and the tail.
    found = keep(candidates(spark, path, queries, cfg, documents, made, query_cache), "candidates")
    first = rerank.rerank(found, queries, clouds, cfg.rerank_n)
    if not cfg.exact_n:
        return first
    # The tail of the second stage is the first stage's result, both its parts.
    second = rerank.rerank(keep(first, "first-stage"), queries, documents, cfg.exact_n)
    return second.withColumn("stage", F.when(F.col("stage") == "rerank", "exact").otherwise("tail"))


def evaluate(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return metrics.mean(metrics.against_truth(results, truth, k), "recall", "hit", "ndcg")


def clouds(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Packed queries and documents of the driver's tables."""
    toks = tables.tokens(spark, folder)
    return tables.pack(tables.query_tokens(toks), "qid"), tables.pack(toks, "doc_id")


def truth(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    return chamfer.topk(queries, documents, k)
