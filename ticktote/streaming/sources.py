"""Stream sources and the run-to-completion helper."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktote.sources.files import scratch_dir

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tick_stream(spark: SparkSession, path: str, pattern: str = "events.parquet", files_per_batch: int = 1) -> DataFrame:
    """Tick events from a folder of parquet files; ts is the event time."""
    rd = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    return rd.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_of(spark: SparkSession, stored: DataFrame) -> DataFrame:
    """A stored table as a stream that takes all its files in one batch."""
    folder = stored.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(stored.schema).parquet(folder)


def fed_stream(spark: SparkSession, df: DataFrame, part: str, name: str) -> tuple[DataFrame, list[Callable[[], None]]]:
    """df as a stream that gets its rows part by part, in the order of the column `part`, and the steps that hand them over.

    df is written once. A step moves the files of a part into the folder that the stream reads.
    """
    base, jvm = scratch_dir(spark, name), spark._jvm
    df.write.partitionBy(part).parquet(f"{base}/held")
    jvm.System.gc()  # the cleaner then removes the files of df's exchanges, which would stay beside the stream's
    path = jvm.org.apache.hadoop.fs.Path
    store = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path(f"{base}/in"))
    held = [s.getPath() for s in store.listStatus(path(f"{base}/held"))]
    parts = {int(p.getName().partition("=")[2]): p for p in held if p.getName().startswith(f"{part}=")}

    def hand_over(k: int) -> None:
        for s in store.listStatus(parts[k]):
            if not store.rename(s.getPath(), path(f"{base}/in/{k}-{s.getPath().getName()}")):
                raise OSError(f"{s.getPath()} was not handed to the stream")

    return spark.readStream.schema(df.drop(part).schema).parquet(f"{base}/in"), [partial(hand_over, k) for k in sorted(parts)]


def stream_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of the same application for streams, with the state store they need; spark keeps its settings.

    partitions is the number of state stores of each stateful operator; if none is given, the submitter's setting of
    spark.sql.shuffle.partitions holds.
    """
    s = spark.newSession()
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if partitions:
        s.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return s


def run_to_end(df: DataFrame, name: str, mode: str = "append", into: SparkSession | None = None) -> DataFrame:
    """Process what is available into a parquet sink with its own checkpoint and read the sink back, in the session `into`."""
    base = scratch_dir(df.sparkSession, name)
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return (into or df.sparkSession).read.schema(df.schema).parquet(f"{base}/out")


END = "2200-01-01 00:00:00"


def run_closed(source: DataFrame, build: Callable[[DataFrame], DataFrame], name: str, into: SparkSession | None = None, ts: str = "ts", feed: list[Callable[[], None]] | None = None) -> DataFrame:
    """All output of build(source) for a source that has ended, its last rows included.

    The query first runs to the end of the source, or of what each step of feed hands to the source. Then an end mark, a row with a time after all others and nothing
    else, moves the watermark past every row, and the query goes on from its checkpoint and lets go of what it held.
    """
    spark = source.sparkSession
    base = scratch_dir(spark, name)
    spark.createDataFrame([], source.schema).write.parquet(f"{base}/end")
    df = build(source.unionByName(spark.readStream.schema(source.schema).parquet(f"{base}/end")))

    def close() -> None:
        mark = [F.lit(END if f.name == ts else None).cast(f.dataType).alias(f.name) for f in source.schema]
        spark.range(1).select(*mark).write.mode("append").parquet(f"{base}/end")

    for step in [*([lambda: None] if feed is None else feed), close]:
        step()
        q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    return (into or spark).read.schema(df.schema).parquet(f"{base}/out")


def run_batches(df: DataFrame, name: str, fn) -> str:
    """Process what is available through fn(batch, batch_id, folder); returns the folder."""
    base = scratch_dir(df.sparkSession, name)
    q = df.writeStream.foreachBatch(lambda b, i: fn(b, i, f"{base}/out")).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{base}/out"
