"""Totals of a folder tree of any depth, bottom up, and statistics that merge on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """A folder and all folders above it; the root is the empty path."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def tree_totals(folders: DataFrame, stats: DataFrame, path: str = "path") -> DataFrame:
    """(path, depth, leaves, present, complete, totals...) of every folder of a tree.

    `folders` has the paths that should be there; those with none below them are leaves.  `stats` has the numbers, and text
    values, of the folders that have an index.  A folder with an index of its own stands for all below it; another one is
    complete when all folders directly below are, and then has their totals: sums of numbers, and of a text
    column the first value in the order of paths that is neither null nor empty.  An incomplete folder's are null.

    Each folder is expanded to its ancestors, whose sums are taken before the shuffle, so the root is no hot key and
    the depth has no bound.  A path given twice in `folders` counts once; in `stats` its rows are one index.
    """
    clean = lambda df: df.where(F.col(path).isNotNull()).withColumn(path, F.array_join(F.filter(F.split(path, "/"), lambda x: x != ""), "/"))
    values = [f for f in stats.schema.fields if f.name != path]
    texts = [f.name for f in values if f.dataType.typeName() == "string"]
    numbers = [f.name for f in values if f.name not in texts]
    keep = lambda c, order: F.min_by(c, F.when(F.col(c) != "", F.col(order)))
    own = clean(stats).groupBy(path).agg(F.lit(True).alias("__own"), *[F.sum(c).alias(c) for c in numbers], *[keep(c, path).alias(c) for c in texts])
    every = clean(folders).select(path).unionByName(own.select(path)).distinct()
    above = every.select(F.col(path).alias("__leaf"), F.explode(ancestors(F.col(path))).alias(path))
    inner = above.where(F.col("__leaf") != F.col(path)).select(path).distinct()
    covered = above.where(F.col("__leaf") != F.col(path)).join(own.select(path), path, "left_semi").select(F.col("__leaf").alias(path)).distinct()
    leaves = every.join(own, path, "left").join(inner.withColumn("__inner", F.lit(True)), path, "left").where("__own OR __inner IS NULL").join(covered, path, "left_anti")
    up = leaves.withColumn("__leaf", F.col(path)).withColumn(path, F.explode(ancestors(F.col(path))))
    kinds = {f.name: f.dataType for f in values}
    out = up.groupBy(path).agg(F.count(F.lit(1)).alias("leaves"), F.count("__own").alias("present"), *[F.sum(c).alias(c) for c in numbers], *[keep(c, "__leaf").alias(c) for c in texts])
    out = out.withColumn("complete", F.col("leaves") == F.col("present")).withColumn("depth", F.when(F.col(path) == "", 0).otherwise(F.size(F.split(path, "/"))))
    return out.select(path, "depth", "leaves", "present", "complete", *[F.when(F.col("complete"), F.col(c)).alias(c) for c in kinds])


def folder_sketches(rows: DataFrame, folder: str, item: str, value: str) -> DataFrame:
    """(folder, n, total, least, most, items, quantiles): statistics of each folder that merge without its rows.

    items is a sketch of the distinct `item`s (standard error about 1.04 / sqrt(4096)), quantiles one of the whole numbers
    `value` (rank error below 1.7 %); both are of a bounded size.
    """
    v = F.col(value).cast("long")
    return rows.groupBy(folder).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.hll_sketch_agg(F.col(item), F.lit(12)).alias("items"), F.kll_sketch_agg_bigint(v, F.lit(200)).alias("quantiles"))


def merge_sketches(sketches: DataFrame, by: list[Column]) -> DataFrame:
    """folder_sketches() of the unions of folders, in whatever order and at whatever level they are merged."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_bigint("quantiles").alias("quantiles"))


def read_sketches(sketches: DataFrame, percents: list[int]) -> DataFrame:
    """The sketches with what they say: distinct (items), and percentiles, a map from '50' to a value."""
    at = F.map_from_arrays(F.array(*[F.lit(str(p)) for p in percents]), F.array(*[F.kll_sketch_get_quantile_bigint("quantiles", F.lit(p / 100.0)) for p in percents]))
    return sketches.withColumn("distinct", F.hll_sketch_estimate("items")).withColumn("percentiles", at).drop("items", "quantiles")
