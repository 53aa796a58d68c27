"""Samples that a run can repeat."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sample_queries(spark: SparkSession, queries: dict[str, str], n: int, seed: int = 42) -> DataFrame:
    """qid, text of n queries drawn with replacement on the driver; a draw's number follows ``__rep`` in its id."""
    ids, rng = sorted(queries), random.Random(seed)
    drawn = [(f"{q}__rep{i}", queries[q]) for i, q in enumerate(rng.choices(ids, k=n))] if ids else []
    return spark.createDataFrame(drawn, "qid string, text string")


def original(qid: F.Column) -> F.Column:
    return F.split(qid, "__rep")[0]


def qrels_of_sample(qrels: DataFrame, sample: DataFrame) -> DataFrame:
    """The judgements of each drawn query, under its own id."""
    ids = sample.select(F.col("qid").alias("drawn"), original(F.col("qid")).alias("qid"))
    return qrels.join(ids, "qid").select(F.col("drawn").alias("qid"), "doc_id", "rel")


def training_rows(rows: DataFrame, share: float, seed: int = 42) -> DataFrame:
    return rows if share >= 1 else rows.sample(fraction=share, seed=seed)
