"""Dataset statistics, merges and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The reported percentiles.
PERCENTS = [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 99, 100]


def percentiles(column: str) -> Column:
    """Exact percentiles, linear between neighbours, cut to whole numbers (of which rounding in the
    interpolation may leave a hair): map '0'..'100' to int (A3)."""
    values = F.percentile(column, F.array(*[F.lit(p / 100.0) for p in PERCENTS]))
    return F.map_from_arrays(F.array(*[F.lit(str(p)) for p in PERCENTS]), F.transform(values, lambda x: (x + 1e-6).cast("int")))


def folder_stats(chunks: DataFrame, skipped: DataFrame, folder: str = "folder") -> DataFrame:
    """FOLDER_STATS of chunk lengths (folder, len) and skipped tokens (folder, skipped) (A2, A3)."""
    written = chunks.groupBy(folder).agg(F.sum("len").cast("bigint").alias("total_tokens_written"), percentiles("len").alias("percentiles"))
    gone = skipped.groupBy(folder).agg(F.sum("skipped").cast("bigint").alias("total_tokens_skipped"))
    return written.join(gone, folder, "full").select(
        folder, F.coalesce("total_tokens_written", F.lit(0)).cast("bigint").alias("total_tokens_written"),
        F.coalesce("total_tokens_skipped", F.lit(0)).cast("bigint").alias("total_tokens_skipped"),
        F.lit(0).cast("bigint").alias("total_duplicated_tokens"), "percentiles",
    )


def length_histogram(df: DataFrame, n: Column, key: str) -> DataFrame:
    """(bucket, rows, members): rows of each thousand of lengths, and their keys in order (A4).

    The member list is the point of this report; it is as long as its bucket.
    """
    from sievework.functions.text import length_bucket

    return df.groupBy(length_bucket(n).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_list(key)).alias("members"))


def histogram_members(df: DataFrame, n: Column, key: str) -> DataFrame:
    """(bucket, key): the members of length_histogram() as rows, for buckets too large for one list (A4)."""
    from sievework.functions.text import length_bucket

    return df.select(length_bucket(n).alias("bucket"), key)


def same_totals(left: DataFrame, right: DataFrame, key: str, n: str = "n") -> DataFrame:
    """(key, left_n, right_n, same) of two tables of totals, keys of either side; a missing total counts as 0."""
    out = left.select(key, F.col(n).alias("__l")).join(right.select(key, F.col(n).alias("__r")), key, "full")
    return out.select(key, F.coalesce("__l", F.lit(0)).cast("bigint").alias("left_n"), F.coalesce("__r", F.lit(0)).cast("bigint").alias("right_n")).withColumn("same", F.col("left_n") == F.col("right_n"))


def merge_stats(stats: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Totals of each dataset and of all together (dataset null), percentiles left out; of a text column its
    smallest value, as rows have no order (A6)."""
    kinds = {f.name: f.dataType.typeName() for f in stats.schema.fields if f.name != dataset}
    numbers = [F.sum(c).alias(c) for c, k in kinds.items() if k in ("integer", "long", "double")]
    return stats.rollup(dataset).agg(*numbers, *[F.min(c).alias(c) for c, k in kinds.items() if k == "string"])


def renormalise(df: DataFrame, value: str, out: str) -> DataFrame:
    """Share of each row in the column's sum, in percent (A10)."""
    return df.withColumn(out, F.col(value) / F.sum(value).over(Window.partitionBy()) * 100)


def audit_split(main: DataFrame, train: DataFrame, valid: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Counts of (dataset, n) tables side by side, train ratio, and the two checks."""
    a = main.select(dataset, F.col("n").alias("main_n"))
    out = a.join(train.select(dataset, F.col("n").alias("t")), dataset, "left").join(valid.select(dataset, F.col("n").alias("v")), dataset, "left")
    out = out.withColumn("train_n", F.coalesce("t", F.lit(0)).cast("bigint")).withColumn("valid_n", F.coalesce("v", F.lit(0)).cast("bigint")).drop("t", "v")
    ratio = F.col("train_n") / F.greatest(F.col("main_n"), F.lit(1))
    return out.withColumn("train_ratio", ratio).withColumn("ratio_ok", F.abs(ratio - 0.999) <= 0.001 + 1e-12).withColumn("total_ok", F.col("train_n") + F.col("valid_n") == F.col("main_n"))


def mismatches(left: DataFrame, right: DataFrame, key: str, n: str = "n") -> DataFrame:
    """(key, left_n, right_n) where the counts differ; a missing one counts as 0."""
    out = left.select(key, F.col(n).alias("left_n")).join(right.select(key, F.col(n).alias("__r")), key, "left")
    return out.withColumn("right_n", F.coalesce("__r", F.lit(0)).cast("bigint")).drop("__r").where("left_n <> right_n")


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work that is not done yet."""
    return work.join(done.select(key), key, "left_anti")


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, least, quartiles and greatest of a column as one row."""
    q = lambda p: F.percentile(column, F.lit(p))
    return df.agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("least"),
        q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max(column).alias("greatest"),
    )
