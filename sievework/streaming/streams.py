"""Structured Streaming: resumable ingest, running statistics, event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1, kind: str = "parquet") -> DataFrame:
    """New files of a folder, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(folder)


def ingest(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Takes in what is there and stops; run again, it goes on after the last finished file."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> None:
    """Hands every micro-batch to a function."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def to_table(df: DataFrame, folder: str, mode: str = "complete", available_now: bool = True) -> DataFrame:
    """Runs a streaming plan over all that is there into files of `folder`, and reads them: nothing passes the driver.

    Every micro-batch has a folder of its own, which a retry overwrites.  Run again on the same folder, the plan goes on
    where it stopped, and the result still is the whole one: with `append` all batches of all runs, with `complete` the
    last batch, of whatever run.  A source that knows no end of what is there takes `available_now` false: it is
    asked until it has nothing more.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/data/batch={number}")

    writer = df.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{folder}/state")
    if available_now:
        writer.trigger(availableNow=True).start().awaitTermination()
    else:
        running = writer.start()
        try:
            running.processAllAvailable()
        finally:
            running.stop()
    return read_batches(df.sparkSession, folder, df.schema, last=mode == "complete")


def read_batches(spark: SparkSession, folder: str, schema: T.StructType, last: bool = False) -> DataFrame:
    """What to_table() has written into `folder` so far: all batches, or the last one; no row before the first batch."""
    fields = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
    try:
        every = spark.read.schema(T.StructType([*fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/data")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType(fields))
    if last:
        numbers = {int(p.rsplit("batch=", 1)[1].split("/")[0]) for p in every.inputFiles()}
        every = every.where(F.col("batch") == max(numbers)) if numbers else every
    return every.select(*[f.name for f in fields])


def running_stats(stream: DataFrame, folder: str, n: str) -> DataFrame:
    """Rows and total of each folder, kept up to date."""
    return stream.groupBy(folder).agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("total"))


def tumbling(events: DataFrame, ts: str, width: str, delay: str, *aggs) -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width)).agg(*aggs)


def sliding(events: DataFrame, ts: str, width: str, step: str, delay: str, *aggs) -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width, step)).agg(*aggs)


def sessions(events: DataFrame, ts: str, key: str, gap: str, delay: str, *aggs) -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap)).agg(*aggs)


def interval_pairs(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, delay: str) -> DataFrame:
    """Pairs of one key whose right row comes at the left one's time or at most `within` later (stream to stream).

    Both sides have a watermark and the times bound each other, so that rows too old to find a partner leave the
    state; the sides' other columns must differ in name.
    """
    a, b = left.withWatermark(left_ts, delay), right.withWatermark(right_ts, delay).withColumnRenamed(key, "__key")
    near = (F.col("__key") == F.col(key)) & (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).drop("__key")


def dedup(events: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
