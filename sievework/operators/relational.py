"""Joins that Spark has no keyword for, and report orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Points with the ranges lo <= at < hi that hold them.

    Both sides are cut into cells of `width`, which makes it an equi-join; a range is copied to each cell
    it touches, so `width` should be near a usual range's length.
    """
    cells = ranges.where(F.col(hi) > F.col(lo)).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    return points.withColumn("__cell", F.floor(F.col(at) / width)).join(cells, "__cell").where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("__cell")


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, value: str, out: str, width: float | None = None) -> DataFrame:
    """`left` with the last `value` of `right` at or before its time, of the same key; null if there is none.

    Null values of `right` are passed over.  With `width` (seconds of a timestamp, else units of `at`) a key's rows are cut
    into cells of time, each a window of its own, and only the last value of each cell is carried over to later ones,
    so that a key with a third of all rows is many tasks.
    """
    names = left.columns
    a = left.withColumns({"__side": F.lit(1), "__v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(by, at, F.col(value).alias("__v")).withColumn("__side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    if width is None:
        w = Window.partitionBy(by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn(out, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select(*names, out)
    kind = left.schema[at].dataType.typeName()
    number = F.col(at).cast("timestamp").cast("double") if kind.startswith("timestamp") else F.col(at).cast("double")
    both = both.withColumn("__c", F.floor(number / width))
    cells = both.groupBy(by, "__c").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(at))).alias("__last"))
    before = Window.partitionBy(by).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    carry = cells.select(by, "__c", F.last("__last", ignorenulls=True).over(before).alias("__carry"))
    w = Window.partitionBy(by, "__c").orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("__here", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    carried = carry.withColumnsRenamed({by: "__by", "__c": "__cc"})
    joined = here.join(carried, F.col(by).eqNullSafe(F.col("__by")) & F.col("__c").eqNullSafe(F.col("__cc")), "left")
    return joined.withColumn(out, F.coalesce("__here", "__carry")).select(*names, out)


def numeric_suffix(name: Column) -> Column:
    """The number at a name's end, null if there is none (O1)."""
    return F.regexp_extract(name, r"(\d+)$", 1).try_cast("bigint")


def category_order(value: Column, order: list[str]) -> Column:
    """Place of a value in a given order, unknown ones last (O3)."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), value)
    return F.when(at > 0, at).otherwise(len(order) + 1).cast("int")
