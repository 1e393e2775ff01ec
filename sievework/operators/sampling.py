"""Ordinals, seeded permutations, running totals and token-budget samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import draw, order_key
from sievework.session import stored


def prefix_sum(df: DataFrame, order: list[Column], value: Column, out: str, by: Column) -> DataFrame:
    """`df` with the running total of `value` in `order`, no task holding more than one bucket of rows.

    `by` must be a bucket that is constant or rises along `order` (for instance the first hex digits of
    an md5 key).  Totals of the buckets before are added to a running total inside each bucket.  The bucket
    table is joined without a hint: Spark broadcasts it only where its measured size is small.
    """
    rows = df.withColumn("__b", by)
    base = rows.groupBy("__b").agg(F.sum(value).alias("__s"))
    base = base.withColumn("__base", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__b", "__base")
    inside = F.sum(value).over(Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__in", inside).join(base, "__b").withColumn(out, (F.col("__in") + F.col("__base")).cast("bigint")).drop("__b", "__in", "__base")


def ordinal(df: DataFrame, order: list[Column], out: str = "rn") -> DataFrame:
    """`df` with its ordinal (from 1) in `order`: a range-partitioned sort, then offsets of the partitions.

    The order must not have ties.  The bounds of a range partitioning are drawn anew whenever it is computed,
    so the sorted rows are written once to the shared folder with their part and place, and both the rows
    and the counts are read from there.  Nothing but one count for each partition meets in a single task, or is broadcast.
    """
    name = "__" + out
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    part = F.shiftrightunsigned(F.col(name), 33)
    local = F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    numbered = stored(ranged.withColumn("__p", part).withColumn("__i", local), "ordinal")
    counts = numbered.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__base")
    return numbered.join(F.broadcast(base), "__p").withColumn(out, (F.col("__i") + 1 + F.col("__base")).cast("bigint")).drop(name, "__p", "__i", "__base")


def running_total(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """`df` with the running total of `value` in `order`, which must not have ties: parts of a sort by range, then their offsets.

    As in ordinal() the sorted rows are written once, with their part; a part is a window of its own, and one total for
    each part meets in a single task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    parts = stored(ranged.withColumn("__p", F.shiftrightunsigned("__id", 33)), "running")
    totals = parts.groupBy("__p").agg(F.sum(value).alias("__s"))
    base = totals.withColumn("__base", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__base")
    inside = F.sum(value).over(Window.partitionBy("__p").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("__in", inside).join(base, "__p").withColumn(out, (F.col("__in") + F.col("__base")).cast("bigint")).drop("__id", "__p", "__in", "__base")


def permute(df: DataFrame, key: str, seed: int, out: str = "rn") -> DataFrame:
    """`df` with its place (from 1) in a seeded random order (W2): md5 of key and seed, ties by the key."""
    k = order_key(F.col(key), F.lit(seed))
    return prefix_sum(df.withColumn("__k", k), [F.asc("__k"), F.asc(key)], F.lit(1), out, F.substring("__k", 1, 3)).drop("__k")


def stop_after(df: DataFrame, key: str, n: str, target: int, seed: int) -> DataFrame:
    """Rows in random order while the total before them is below the target (M1); keeps cum."""
    k = order_key(F.col(key), F.lit(seed))
    cum = prefix_sum(df.withColumn("__k", k), [F.asc("__k"), F.asc(key)], F.col(n), "cum", F.substring("__k", 1, 3)).drop("__k")
    return cum.where(F.col("cum") - F.col(n) < target)


def stop_before(df: DataFrame, key: str, n: str, budget: int, seed: int) -> DataFrame:
    """Rows in random order while the total with them is within the budget (the first overflow ends it); keeps cum."""
    k = order_key(F.col(key), F.lit(seed))
    cum = prefix_sum(df.withColumn("__k", k), [F.asc("__k"), F.asc(key)], F.col(n), "cum", F.substring("__k", 1, 3)).drop("__k")
    return cum.where(F.col("cum") <= budget)


def group_stop_before(df: DataFrame, group: str, key: str, n: str, budget: int, seed: int) -> DataFrame:
    """stop_before() within each group (W4), in two levels, so that a group of a third of all rows is many tasks."""
    k = order_key(F.col(key), F.lit(seed))
    rows = df.withColumn("__k", k).withColumn("__b", F.substring("__k", 1, 2))
    sums = rows.groupBy(group, "__b").agg(F.sum(n).alias("__s"))
    before = sums.withColumn("__base", F.coalesce(F.sum("__s").over(Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(group, "__b", "__base")
    inside = rows.withColumn("__in", F.sum(n).over(Window.partitionBy(group, "__b").orderBy("__k", key).rowsBetween(Window.unboundedPreceding, 0)))
    cum = inside.join(before, [group, "__b"]).withColumn("cum", (F.col("__in") + F.col("__base")).cast("bigint"))
    return cum.where(F.col("cum") <= budget).drop("__k", "__b", "__in", "__base")


def sample_folders(stats: DataFrame, target: int, seed: int, folder: str = "folder", n: str = "tokens") -> DataFrame:
    """Folders without replacement until the target is reached; folders without a count take no part (M2, M3)."""
    return stop_after(stats.where(F.col(n).isNotNull()), folder, n, target, seed)


def resample_folders(stats: DataFrame, target: int, seed: int, folder: str = "folder", n: str = "tokens") -> DataFrame:
    """(folder, tokens, copy_id): sample_folders, then draws with replacement until the target (M4).

    copy_id 0 is the folder itself.  The number of draws is bounded by what remains over the smallest
    folder.  An empty pool, or one without tokens, raises an error instead of drawing for ever.
    """
    used = sample_folders(stats.where(F.col(n) > 0), target, seed, folder, n)
    s = used.agg(F.coalesce(F.sum(n), F.lit(0)).alias("have"), F.min(n).alias("least"), F.count(F.lit(1)).alias("folders")).first()
    if not s.folders:
        raise ValueError("no folder has tokens")
    base = used.select(folder, n, F.lit(0).cast("bigint").alias("copy_id"))
    if s.have >= target:
        return base
    pool = ordinal(used.select(folder, n), [F.asc(folder)], "rn").select(folder, n, (F.col("rn") - 1).alias("pick"))
    draws = stats.sparkSession.range(1, -(-(target - s.have) // s.least) + 1).select(F.col("id").alias("copy_id"), (draw(F.lit(seed), F.col("id")) % s.folders).alias("pick"))
    picked = draws.join(pool, "pick")
    cum = prefix_sum(picked, [F.asc("copy_id")], F.col(n), "cum", F.floor(F.col("copy_id") / 4096))
    more = cum.where(F.col("cum") - F.col(n) < target - s.have).select(folder, n, "copy_id")
    return base.unionByName(more)


def mixture_budget(weights: DataFrame, total: int, skip: list[str] | None = None, domain: str = "domain", pct: str = "pct") -> DataFrame:
    """(domain, pct, budget): percentages renormalised after skipping domains, whole-token budgets."""
    kept = weights.where(~F.col(domain).isin(skip)) if skip else weights
    share = F.col(pct) / F.sum(pct).over(Window.partitionBy()) * 100
    return kept.select(domain, share.alias("pct")).withColumn("budget", F.floor(F.lit(float(total)) * F.col("pct") / 100 + 1e-9).cast("bigint"))


def mixture_sample(rows: DataFrame, budgets: DataFrame, seed: int, key: str = "id", n: str = "tokens", domain: str = "domain") -> DataFrame:
    """(key, domain, n, epoch): rows of each domain in random order until its budget, in whole further passes if needed (M7)."""
    pool = rows.where(F.col(n) > 0)
    totals = pool.groupBy(domain).agg(F.sum(n).alias("__total")).join(budgets.select(domain, "budget"), domain).where("budget > 0")
    epochs = totals.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("budget") / F.col("__total")).cast("bigint") - 1)))
    # rows before an epoch sum to epoch * total, so one pass's running totals serve every epoch
    k = order_key(F.col(key), F.lit(seed))
    keyed = pool.select(key, domain, n, k.alias("__k"))
    bucket = F.substring("__k", 1, 2)
    part = keyed.withColumn("__b", bucket)
    sums = part.groupBy(domain, "__b").agg(F.sum(n).alias("__s"))
    before = sums.withColumn("__base", F.coalesce(F.sum("__s").over(Window.partitionBy(domain).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(domain, "__b", "__base")
    inside = part.withColumn("__in", F.sum(n).over(Window.partitionBy(domain, "__b").orderBy("__k", key).rowsBetween(Window.unboundedPreceding, 0)))
    cum = inside.join(before, [domain, "__b"]).withColumn("__before", F.col("__in") + F.col("__base") - F.col(n))
    return cum.join(epochs, domain).where(F.col("epoch") * F.col("__total") + F.col("__before") < F.col("budget")).select(key, domain, n, "epoch")


def split_one_folder(rows: DataFrame, seed: int, fraction: float = 0.001, key: str = "id", n: str = "tokens", folder: str = "folder") -> DataFrame:
    """`rows` with split: validation rows come from one random folder within int(total * fraction) tokens (M5)."""
    stats = rows.groupBy(folder).agg(F.sum(n).alias("t"))
    total = stats.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
    budget = int(total * fraction)
    chosen = stats.orderBy(order_key(F.col(folder), F.lit(seed)), folder).limit(1).first()
    if chosen is None or chosen.t < budget:
        raise ValueError("the chosen folder holds less than the validation budget")
    valid = stop_before(rows.where(F.col(folder) == chosen[0]).select(key, n), key, n, budget, seed).select(key, F.lit("validation").alias("__s"))
    return rows.join(valid, key, "left").withColumn("split", F.coalesce("__s", F.lit("train"))).drop("__s")


def split_unseen(rows: DataFrame, sampled: DataFrame, budget: int, seed: int, key: str = "id", n: str = "tokens", folder: str = "folder") -> DataFrame:
    """Validation rows from folders that `sampled` lacks: whole folders in random order, then part of one (M6).

    A row's place is its folder's, then its own; the total stays within the budget.
    """
    rest = rows.join(sampled.select(folder).distinct(), folder, "left_anti")
    # folders first: what a folder's rows begin with, and folders that begin beyond the budget go
    totals = rest.groupBy(folder).agg(F.sum(n).alias("__t")).withColumn("__f", order_key(F.col(folder), F.lit(seed)))
    begun = prefix_sum(totals, [F.asc("__f"), F.asc(folder)], F.col("__t"), "__end", F.substring("__f", 1, 3)).select(folder, (F.col("__end") - F.col("__t")).alias("__begin"))
    near = rest.join(begun.where(F.col("__begin") <= budget), folder)
    # then inside each folder, in parts by the row's key, so that a large folder is many tasks
    inside = group_stop_before(near, folder, key, n, budget, seed)
    return inside.where(F.col("__begin") + F.col("cum") <= budget).drop("__begin", "cum")


def folder_subset(stats: DataFrame, most: int, seed: int, folder: str = "folder") -> DataFrame:
    """At most `most` folders, chosen at random (M8)."""
    return stats.orderBy(order_key(F.col(folder), F.lit(seed)), folder).limit(most)


def test_split(df: DataFrame, key: str, test_rows: int, seed: int, train_rows: int | None = None) -> DataFrame:
    """`df` with split: the first test_rows of a random order are test, then train up to train_rows (M9)."""
    out = permute(df, key, seed).withColumn("split", F.when(F.col("rn") <= test_rows, "test").otherwise("train"))
    return out if train_rows is None else out.where(F.col("rn") <= test_rows + train_rows)


def no_duplicate_batches(df: DataFrame, text: str, key: str) -> DataFrame:
    """`df` with batch_offset: equal texts get different numbers, so no batch of one number repeats a text."""
    return df.withColumn("batch_offset", F.row_number().over(Window.partitionBy(text).orderBy(key)) - 1)
