"""Incremental export by folders to any place that Spark can write, with a manifest that makes it safe to repeat."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A line of the manifest: a folder's rows in one commit, and a sum over the rows' hashes.
MANIFEST = "folder string, rows bigint, digest decimal(38,0), commit string"


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """What has been exported so far; empty before the first commit."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{target}/manifest/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def commit(rows: DataFrame, target: str, folder: str, name: str) -> None:
    """Writes the rows, a Parquet folder for each value of `folder`, and then the manifest of this commit.

    Both overwrite what an earlier attempt of the same name has left, and rows count only once their manifest is there:
    a run that breaks at any place can be repeated under the same name and leaves each row once.
    """
    data = f"{target}/data/__commit={name}"
    rows.withColumn("__folder", F.col(folder)).write.mode("overwrite").option("compression", "zstd").partitionBy("__folder").parquet(data)
    # the manifest describes the files that are there, not the rows computed again
    there = rows.sparkSession.read.schema(rows.schema).parquet(data)
    lines = there.groupBy(F.col(folder).cast("string").alias("folder")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("digest"))
    lines.withColumn("commit", F.lit(name)).write.mode("overwrite").parquet(f"{target}/manifest/{name}")


def export_folders(rows: DataFrame, target: str, folder: str, name: str) -> int:
    """Exports the folders that no manifest names yet as one commit; their number.

    Done folders are left out by an anti-join before anything is written.
    """
    done = manifest(rows.sparkSession, target).where(F.col("commit") != name).select(F.col("folder").alias("__done")).distinct()
    open_ = rows.join(done, F.col(folder).cast("string").eqNullSafe(F.col("__done")), "left_anti")
    commit(open_, target, folder, name)
    return manifest(rows.sparkSession, target).where(F.col("commit") == name).count()


def export_stream(stream: DataFrame, target: str, folder: str, checkpoint: str) -> None:
    """Exports a stream, each micro-batch a commit of its number; a batch that runs twice overwrites itself."""
    stream.writeStream.foreachBatch(lambda batch, number: commit(batch, target, folder, f"batch-{number:09d}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def exported(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The rows of all finished commits; those of a broken one are not seen."""
    fields = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
    try:
        every = spark.read.schema(T.StructType([*fields, T.StructField("__commit", T.StringType())])).parquet(f"{target}/data")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType(fields))
    finished = manifest(spark, target).select(F.col("commit").alias("__commit")).distinct()
    return every.join(finished, "__commit", "left_semi").select(*[f.name for f in fields])


def verify(spark: SparkSession, target: str, schema: T.StructType, folder: str) -> DataFrame:
    """(folder, rows, found_rows, same): the manifest's totals against the files that are there."""
    said = manifest(spark, target).groupBy("folder").agg(F.sum("rows").alias("rows"), F.sum("digest").alias("digest"))
    names = [f.name for f in schema.fields]
    there = exported(spark, target, schema).groupBy(F.col(folder).cast("string").alias("__f")).agg(F.count(F.lit(1)).alias("found_rows"), F.sum(F.xxhash64(*names).cast("decimal(38,0)")).alias("__d"))
    out = said.join(there, F.col("folder").eqNullSafe(F.col("__f")), "full")
    return out.select(F.coalesce("folder", "__f").alias("folder"), "rows", "found_rows", (F.col("rows").eqNullSafe(F.col("found_rows")) & F.col("digest").eqNullSafe(F.col("__d"))).alias("same"))
