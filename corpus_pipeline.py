"""From raw documents to packed sequences: toxicity, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents. A null doc_id names no document: such rows pass the filters by their text like any other, and the
near-duplicate stage leaves them in. Of rows that repeat a doc_id the near-duplicate stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import packing, quality, simhash, toxicity
from tesserae.session import keep


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't find toxic."""
    return toxicity.clean(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds good."""
    return quality.good(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id."""
    first = simhash.near_duplicates(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id")
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in sequences of 2048 tokens."""
    return packing.pack(docs, capacity=2048)


STAGES = [("toxicity", toxicity_stage), ("quality", quality_stage), ("simhash_dedup", dedup_stage), ("best_fit_packing", packing_stage)]

#: Compression, fingerprints and token ids are beyond SQL; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
