"""Sessions, and the folder that all executors share for what cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """For tests and the bench; on a cluster the submitter's own session is used."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tesserae")
    defaults = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, in local mode only, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tesserae-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tesserae-{spark.sparkContext.applicationId}"


def place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet in the shared folder and read again: later plans start there, and a lost executor takes nothing along.

    The tables stay until ``forget``, as results that haven't been computed may read them.
    """
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Removes all tables that this application has kept. Call it once results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
