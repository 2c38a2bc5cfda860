"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session that has none (tests) gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="provloom-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df, computed once, written to the shared folder and read again; deleted when the application ends."""
    spark = df.sparkSession
    to = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(to)
    atexit.register(_delete, spark, to)
    return spark.read.schema(df.schema).parquet(to)


def _delete(spark: SparkSession, to: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(to)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder is named for cleaning by hand
        return
