"""Training batches: growing sizes, no repeated text, and orders that need no global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import order_key
from sievework.operators.relational import range_join
from sievework.operators.sampling import ordinal, permute


def warm_up_segments(warm_rows: int, start: int, full: int) -> list[tuple[int, int, int, int]]:
    """(first row, row after the last, first batch, size) of the runs of equal batch sizes until the size is full.

    A batch that begins after r rows has floor(full * r / warm_rows) rows, but at least `start` and at most `full`.
    Sizes only rise, and the row from which a size is due is known, so that a run of batches of one size is one step:
    there are at most full - start + 1 of them.  The last one has no end (-1).
    """
    out, row, batch = [], 0, 0
    while True:
        size = min(full, max(start, full * row // warm_rows)) if row < warm_rows else full
        if size >= full:
            return [*out, (row, -1, batch, full)]
        due = -(-(size + 1) * warm_rows // full)  # the first row at which a larger size is due
        times = -(-(due - row) // size)
        out.append((row, row + times * size, batch, size))
        row, batch = row + times * size, batch + times


def warm_up_batches(df: DataFrame, key: str, seed: int, warm_rows: int, start: int, full: int) -> DataFrame:
    """`df` with rn, batch_no and batch_size: rows in a seeded random order, in batches that grow until warm_rows.

    For rows of T tokens warm_rows is the number of warm-up tokens / T.  The table of segments has at most `full` rows; a
    row finds its own by an equi-join on cells, the last segment by arithmetic.  The last batch may be short.
    """
    if not 0 < start <= full or warm_rows < 1:
        raise ValueError("sizes must be 0 < start <= full, and warm_rows positive")
    *grow, (last_row, _, last_batch, _) = warm_up_segments(warm_rows, start, full)
    rows = permute(df, key, seed).withColumn("__at", F.col("rn") - 1)
    after = rows.where(F.col("__at") >= last_row).withColumn("batch_no", F.lit(last_batch) + F.floor((F.col("__at") - last_row) / full)).withColumn("batch_size", F.lit(full))
    if not grow:
        return after.withColumn("batch_no", F.col("batch_no").cast("bigint")).drop("__at")
    table = df.sparkSession.createDataFrame(grow, "__lo long, __hi long, __first long, batch_size int")
    early = range_join(rows.where(F.col("__at") < last_row), table, "__at", "__lo", "__hi", max(1, last_row // len(grow)))
    early = early.withColumn("batch_no", F.col("__first") + F.floor((F.col("__at") - F.col("__lo")) / F.col("batch_size")))
    names = [*df.columns, "rn", "batch_no", "batch_size"]
    return early.select(*names).unionByName(after.select(*names)).withColumn("batch_no", F.col("batch_no").cast("bigint"))


def distinct_batches(df: DataFrame, text: str, key: str, size: int, seed: int) -> DataFrame:
    """`df` with batch_no: full batches of `size` rows, none with a text twice; the rows over go (fewer than `size`).

    Rows are put in the order of their text's number of copies, the most frequent first, and dealt round the batches, so
    that the copies of a text, being neighbours, fall into different ones.  That needs as many batches as the most
    frequent text has copies: where floor(rows / size) is less, no such batches exist, and a ValueError says so.
    Of rows without a text each counts as a text of its own.  Equal keys are told apart by the text only.
    """
    n = df.where(F.col(text).isNotNull()).groupBy(text).agg(F.count(F.lit(1)).alias("__n"))
    rows, most = df.count(), n.agg(F.max("__n")).first()[0] or 1
    batches = rows // size
    if rows and most > max(batches, 1):
        raise ValueError(f"a text with {most} copies does not fit into {batches} batches of {size} rows")
    order = [F.desc("__n"), F.asc("__t"), F.asc(text), F.asc(key)]
    counted = df.join(n, text, "left").withColumn("__n", F.coalesce("__n", F.lit(1))).withColumn("__t", order_key(F.col(text), F.lit(seed)))
    placed = ordinal(counted, order, "__rn").where(F.col("__rn") <= batches * size)
    return placed.withColumn("batch_no", F.pmod(F.col("__rn") - 1, F.lit(max(batches, 1)))).select(*df.columns, "batch_no")


def block_shuffle(df: DataFrame, block: str, row: str, seed: int, buffer: int) -> DataFrame:
    """`df` with place (from 1): blocks in a seeded random order, and the rows of each `buffer` blocks mixed.

    Only the table of blocks, a row for each, is put in one order; the rows of a buffer are sorted together, and no two
    buffers' rows.  `row` tells the rows of a block apart.
    """
    sizes = df.groupBy(block).agg(F.count(F.lit(1)).alias("__n")).withColumn("__k", order_key(F.col(block), F.lit(seed)))
    ordered = ordinal(sizes, [F.asc("__k"), F.asc(block)], "__rn").withColumn("__g", F.floor((F.col("__rn") - 1) / buffer))
    groups = ordered.groupBy("__g").agg(F.sum("__n").alias("__s"))
    base = groups.withColumn("__base", F.coalesce(F.sum("__s").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__g", "__base")
    w = Window.partitionBy("__g").orderBy(order_key(F.col(block), F.col(row), F.lit(seed)), block, row)
    mixed = df.join(ordered.select(block, "__g"), block).withColumn("__i", F.row_number().over(w))
    return mixed.join(base, "__g").withColumn("place", (F.col("__i") + F.col("__base")).cast("bigint")).select(*df.columns, "place")
