"""Exact rescoring of candidates, and the tail that follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions import vectors


def rerank(candidates: DataFrame, queries: DataFrame, documents: DataFrame, rerank_n: int, digits: int | None = None) -> DataFrame:
    """qid, doc_id, score, stage, rank.

    The first ``rerank_n`` candidates (qid, doc_id, score, rank) of each query are ordered by Chamfer score, ties as they stood; the others
    follow in their old order with their old scores. The two kinds of scores have different units, so rank is the order, never score. Token
    clouds are joined to the candidates that need them only. queries: qid, toks; documents: doc_id, toks.
    """
    head = candidates.where(F.col("rank") <= rerank_n)
    clouds = head.join(documents.select("doc_id", F.col("toks").alias("dt")), "doc_id").join(queries.select("qid", F.col("toks").alias("qt")), "qid")
    exact = vectors.chamfer("qt", "dt")
    scored = clouds.select("qid", "doc_id", (F.round(exact, digits) if digits is not None else exact).alias("score"), F.col("rank").alias("was"), F.lit("rerank").alias("stage"))
    tail = candidates.where(F.col("rank") > rerank_n).select("qid", "doc_id", "score", F.col("rank").alias("was"), F.lit("ann").alias("stage"))
    first = F.when(F.col("stage") == "rerank", F.col("score")).otherwise(F.lit(float("-inf")))
    order = Window.partitionBy("qid").orderBy(F.desc(F.col("stage") == "rerank"), F.desc(first), "was")
    return scored.unionByName(tail).withColumn("rank", F.row_number().over(order)).select("qid", "doc_id", "score", "stage", "rank")
