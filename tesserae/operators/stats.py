"""What a run says about itself: duplicates in a batch, locality, times, experiment lines."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dup_ratio(candidates: DataFrame, batch: str) -> DataFrame:
    """batch, total, uniq, dup_ratio: the share of a batch's candidate documents that another query of it has too."""
    rows = candidates.groupBy(batch, "doc_id").agg(F.count("*").alias("n")).groupBy(batch)
    sums = rows.agg(F.sum("n").alias("total"), F.count("*").alias("uniq"))
    return sums.select(batch, "total", "uniq", F.when(F.col("total") > 0, 1 - F.col("uniq") / F.col("total")).otherwise(0.0).alias("dup_ratio"))


def locality(ranked: DataFrame, position: str = "doc_id") -> DataFrame:
    """qid, mean_delta, p95_delta: how far apart in the store the documents lie that follow each other in a ranking.

    p95 is the value at place int(0.95 (n - 1)) of the sorted distances; a query with fewer than two documents has 0.
    """
    step = F.abs(F.col(position) - F.lag(position).over(Window.partitionBy("qid").orderBy("rank")))
    rows = ranked.select("qid", "rank", step.alias("delta"))
    deltas = rows.groupBy("qid").agg(F.array_sort(F.collect_list("delta")).alias("d"))
    at = (F.lit(0.95) * (F.size("d") - 1)).cast("int") + 1
    mean = F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.size("d")
    some = F.size("d") > 0
    return deltas.select("qid", F.when(some, mean).otherwise(0.0).alias("mean_delta"), F.when(some, F.element_at("d", F.greatest(at, F.lit(1)))).otherwise(0).cast("long").alias("p95_delta"))


class Stopwatch:
    """Seconds by stage, as a DataFrame sink of experiment lines."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, float]] = []

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((name, time.perf_counter() - began))

    def frame(self, spark: SparkSession, experiment: str) -> DataFrame:
        return spark.createDataFrame([(experiment, n, s) for n, s in self.rows], "experiment string, stage string, seconds double")
