"""Session helpers."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "ticktote", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on.

    Cluster sizing (shuffle partitions, executors, checkpoint folder) is left to
    the submitter; only semantics and adaptive planning are fixed here.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def sized_session(spark: SparkSession, tasks: int) -> SparkSession:
    """spark, or where it has fewer than `tasks` shuffle partitions, a session of the same application that has as many.

    All other settings are those of spark, which keeps its own.
    """
    if tasks <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return spark
    s = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and s.conf.isModifiable(k):
            s.conf.set(k, v)
    s.conf.set("spark.sql.shuffle.partitions", str(tasks))
    return s


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> None:
    """Use the cluster's shared checkpoint folder; set one only where none is set."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if fallback:
        spark.sparkContext.setCheckpointDir(fallback)
