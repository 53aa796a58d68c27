"""Retrieval metrics. Results carry an explicit rank (qid, doc_id, rank); judgements are qid, doc_id, rel; truth is qid, doc_id, score, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _first(results: DataFrame, k: int) -> DataFrame:
    return results.where(F.col("rank") <= k).select("qid", "doc_id", "rank")


def _relevant(judged: DataFrame) -> DataFrame:
    return judged.where("rel > 0")


def _discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def recall_per_query(results: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """qid, n_rel, n_hit, recall for the queries among the results that have relevant documents; n_rel isn't capped at k."""
    rel = _relevant(judged).select("qid", "doc_id")
    asked = results.select("qid").distinct()
    hits = _first(results, k).join(rel, ["qid", "doc_id"]).groupBy("qid").agg(F.count("*").alias("n_hit"))
    every = rel.join(asked, "qid", "left_semi").groupBy("qid").agg(F.count("*").alias("n_rel"))
    return every.join(hits, "qid", "left").select("qid", "n_rel", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), (F.coalesce("n_hit", F.lit(0)) / F.col("n_rel")).alias("recall"))


def recall(results: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """recall: the mean over queries that have relevant documents; 0 if none has."""
    return recall_per_query(results, judged, k).agg(F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"))


def hit(results: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """hit: the share of those queries with a relevant document among the first k."""
    return recall_per_query(results, judged, k).agg(F.coalesce(F.avg((F.col("n_hit") > 0).cast("double")), F.lit(0.0)).alias("hit"))


def ndcg_per_query(results: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """qid, dcg, idcg, ndcg with gains 2^rel - 1."""
    rel = _relevant(judged).select("qid", "doc_id", "rel")
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) * _discount(F.col("rank"))
    got = _first(results, k).join(rel, ["qid", "doc_id"]).groupBy("qid").agg(F.sum(gain).alias("dcg"))
    ideal = rel.join(results.select("qid").distinct(), "qid", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"))))
    best = ideal.where(F.col("rank") <= k).groupBy("qid").agg(F.sum(gain).alias("idcg"))
    dcg = F.coalesce("dcg", F.lit(0.0))
    return best.join(got, "qid", "left").select("qid", dcg.alias("dcg"), "idcg", (dcg / F.col("idcg")).alias("ndcg"))


def against_truth(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """qid, overlap, n_truth, recall, hit, ndcg of every query of the brute-force truth; a query without results counts 0.

    The gain is the truth's score where positive, linear; what the truth's first k lack gains nothing, and a query whose ideal isn't
    positive counts 0.
    """
    ideal = truth.where(F.col("rank") <= k).select("qid", "doc_id", F.greatest("score", F.lit(0.0)).alias("gain"), F.col("rank").alias("ideal"))
    both = ideal.join(_first(results, k), ["qid", "doc_id"], "left")
    sums = both.groupBy("qid").agg(
        F.count("rank").alias("overlap"),
        F.count("*").alias("n_truth"),
        F.sum(F.col("gain") * _discount(F.col("ideal"))).alias("idcg"),
        F.coalesce(F.sum(F.when(F.col("rank").isNotNull(), F.col("gain") * _discount(F.col("rank")))), F.lit(0.0)).alias("dcg"),
    )
    return sums.select(
        "qid",
        "overlap",
        "n_truth",
        (F.col("overlap") / F.col("n_truth")).alias("recall"),
        (F.col("overlap") > 0).cast("double").alias("hit"),
        F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"),
    )


def mean(per_query: DataFrame, *names: str) -> DataFrame:
    return per_query.agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names])


def overlap(judged: DataFrame, documents: DataFrame) -> DataFrame:
    """n_judged, n_found, share: how many of the judged documents the index holds."""
    known = judged.select("doc_id").distinct()
    found = known.join(documents.select("doc_id").distinct().withColumn("here", F.lit(1)), "doc_id", "left")
    return found.agg(F.count("*").alias("n_judged"), F.count("here").alias("n_found"), (F.count("here") / F.greatest(F.count("*"), F.lit(1))).alias("share"))
