"""Search over a stream of queries: micro-batches against a static index.

A micro-batch is a set of query clouds; each is answered by the same plan as a table of queries and appended to a Parquet sink under its
batch number. The rate of the source is the back-pressure, the query's checkpoint makes a batch count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def query_stream(spark: SparkSession, folder: str, schema: str = "qid long, toks array<array<double>>", files: int = 1) -> DataFrame:
    """Packed query clouds from a folder of Parquet files, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def serve(stream: DataFrame, answer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Answers all there is and stops. A batch that is run again overwrites its own folder of the sink."""

    def batch(rows: DataFrame, number: int) -> None:
        answer(rows).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/run={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
