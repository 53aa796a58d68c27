"""Token routing: the tokens of a document in the buckets of several hash tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import vectors


def planes(dimension: int, bits: int, tables: int, seed: int = 42) -> list[np.ndarray]:
    """One generator draws all tables, one after the other."""
    rng = np.random.default_rng(seed)
    return [rng.normal(0.0, 1.0, (dimension, bits)).astype(np.float32).astype(np.float64) for _ in range(tables)]


def route(tokens: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """table_id, bucket (a string of bits), doc_id, tok_id; each token's bucket with that token's own number."""
    made = F.array(*[F.struct(F.lit(i).alias("table_id"), vectors.lsh_bits("v", p).alias("bucket")) for i, p in enumerate(tables)])
    return tokens.select("doc_id", "tok_id", F.explode(made).alias("h")).select("h.*", "doc_id", "tok_id")


def probe(query_tokens: DataFrame, routed: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """qid, doc_id, n: how many (table, token) pairs of a query and a document share a bucket."""
    asks = route(query_tokens.withColumnRenamed("qid", "doc_id"), tables).select("table_id", "bucket", F.col("doc_id").alias("qid"))
    # Both sides are counted before they meet, so a full bucket costs a row a document, not a row a pair of tokens.
    q = asks.groupBy("table_id", "bucket", "qid").agg(F.count("*").alias("nq"))
    d = routed.groupBy("table_id", "bucket", "doc_id").agg(F.count("*").alias("nd"))
    return q.join(d, ["table_id", "bucket"]).groupBy("qid", "doc_id").agg(F.sum(F.col("nq") * F.col("nd")).alias("n"))
