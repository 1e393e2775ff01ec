"""Overlap joins of interval tables by equi-joins on cells of a size that fits each interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(lo: str, hi: str) -> Column:
    """The smallest power of two that is no shorter than the interval."""
    n = F.col(hi) - F.col(lo)
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1))).cast("int")


def _cell(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def _levels(df: DataFrame) -> list[int]:
    return [r[0] for r in df.select("__l").distinct().collect()]  # at most 64


def _posted(df: DataFrame, lo: str, hi: str, levels: Column) -> DataFrame:
    """A row for each of the levels and each of the two cells at most that the interval touches there."""
    at = F.col("__at")
    return df.withColumn("__at", F.explode(levels)).withColumn("__cell", F.explode(F.sequence(_cell(F.col(lo), at), _cell(F.col(hi) - 1, at))))


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose half-open intervals of longs overlap, each pair once, with equal `by` columns if given.

    An interval is posted at the level of cells that are just as long as it is, where it touches two cells at most,
    and at the coarser levels that the other table has: 128 rows at most, however long it is.  A pair meets at the
    coarser of its two levels only, and only in the cell where the later of the two begins, so nothing is
    sorted out afterwards.  Columns other than `by` must differ in name.  Empty intervals, and nulls, overlap nothing.
    """
    (a0, a1), (b0, b1), by = left_span, right_span, by or []
    a = left.where(F.col(a1) > F.col(a0)).withColumn("__l", _level(a0, a1))
    b = right.where(F.col(b1) > F.col(b0)).withColumn("__l", _level(b0, b1))
    at_a, at_b = (F.array(*[F.lit(x) for x in _levels(t)]).cast("array<int>") for t in (a, b))
    own = F.array("__l")
    names = [*by, *[c for c in left.columns if c not in by], *[c for c in right.columns if c not in by]]

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        pairs = x.drop("__l").join(y.drop("__l"), [*by, "__at", "__cell"])
        first = F.col("__cell") == _cell(F.greatest(a0, b0), F.col("__at"))
        return pairs.where(first & (F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1))).select(*names)

    longer = met(_posted(a, a0, a1, own), _posted(b, b0, b1, F.filter(at_a, lambda x: x >= F.col("__l"))))
    shorter = met(_posted(a, a0, a1, F.filter(at_b, lambda x: x > F.col("__l"))), _posted(b, b0, b1, own))
    return longer.unionByName(shorter)
