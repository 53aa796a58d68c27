"""Readers: corpora, queries, relevance judgements, and token clouds made of the driver's vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CLOUD = 5
#: Of the clouds, every twentieth asks; all are searched.
QUERY_EVERY = 20


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, tok_id, v, label: five consecutive vectors are a document's tokens."""
    e = parquet(spark, folder, "embeddings")
    return e.select(F.floor(F.col("vec_id") / CLOUD).alias("doc_id"), (F.col("vec_id") % CLOUD).cast("int").alias("tok_id"), F.col("embedding").alias("v"), "label")


def query_tokens(tokens_: DataFrame) -> DataFrame:
    """qid, tok_id, v of the clouds that ask."""
    return tokens_.where(F.col("doc_id") % QUERY_EVERY == 0).select(F.col("doc_id").alias("qid"), "tok_id", "v")


def pack(tokens_: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, toks ARRAY<ARRAY<DOUBLE>> in order of tok_id: one row a cloud. The one shuffle of a search; store its result."""
    inner = F.array_sort(F.collect_list(F.struct("tok_id", F.col("v").cast("array<double>").alias("v"))))
    return tokens_.groupBy(key).agg(F.transform(inner, lambda t: t["v"]).alias("toks"))


def qrels(tokens_: DataFrame) -> DataFrame:
    """qid, doc_id, score: 1 where the first tokens have one label and the cloud isn't the query's own, 0 for the query's own."""
    first = tokens_.where("tok_id = 0").select("doc_id", "label")
    asks = first.where(F.col("doc_id") % QUERY_EVERY == 0).select(F.col("doc_id").alias("qid"), "label")
    return asks.join(first, "label").select("qid", "doc_id", (F.col("qid") != F.col("doc_id")).cast("int").alias("score"))


def read_corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title, text of a corpus in JSON lines; malformed lines are left out."""
    schema = StructType([StructField(c, StringType()) for c in ("_id", "title", "text")])
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.select(F.col("_id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")


def read_queries_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """qid, text."""
    rows = spark.read.schema("_id string, text string").json(path)
    return rows.select(F.col("_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text")).where("qid is not null")


ALIASES = {"qid": ("query-id", "qid", "query_id"), "doc_id": ("corpus-id", "docid", "doc_id"), "score": ("score", "label")}


def read_qrels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc_id, rel of a headed TSV whose columns may go by other names; malformed rows are skipped, positive ones count 1."""
    raw = spark.read.csv(path, sep="\t", header=True)
    pick = lambda names: F.coalesce(*[F.col(f"`{c}`") for c in names if c in raw.columns] or [F.lit(None)])
    return positive(raw.select(pick(ALIASES["qid"]).alias("qid"), pick(ALIASES["doc_id"]).alias("doc_id"), pick(ALIASES["score"]).alias("score")))


def positive(judged: DataFrame) -> DataFrame:
    """Judgements above zero, each once, as rel 1; scores that are no numbers are skipped."""
    score = F.expr("try_cast(score as int)")
    return judged.where(score > 0).where("qid is not null and doc_id is not null").select("qid", "doc_id", F.lit(1).alias("rel")).dropDuplicates(["qid", "doc_id"])


def head(df: DataFrame, n: int, ordinal: str) -> DataFrame:
    """The first n rows in the order of a stored ordinal; 0 for all."""
    return df.orderBy(ordinal).limit(n) if n else df
