"""Folders and intermediate tables that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Where none is set, a local master gets a temporary folder, which goes when Python ends; any other master is an
    error, as executors and driver would not see each other's files.
    """
    import atexit
    import shutil
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix=f"{name}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: derived once, and not again when executors are lost."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
