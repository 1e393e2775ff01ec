"""Streams across restarts: results, keyed state, late rows, expiry; interval joins."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import intervals
from sievework.streaming import state, streams

SCHEMA = "folder string, id long, n long, part string, ts timestamp"
NOON = dt.datetime(2024, 1, 1, 12)


def put(spark, folder, rows, at: int, schema: str = SCHEMA) -> None:
    """One more file, whose time of change is `at` seconds, so that files have an order."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    for f in os.listdir(folder):
        p = f"{folder}/{f}"
        if os.path.getmtime(p) > 10**9:
            os.utime(p, (at, at))


def test_append_after_restarts(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for run, (new, want) in enumerate([(10, 10), (10, 20), (0, 20)]):
        if new:
            put(spark, src, [("a", run * 10 + k, 1, "", NOON) for k in range(new)], 1000 + run)
        got = streams.to_table(streams.file_stream(spark, src, SCHEMA).select("folder", "id"), out, "append")
        assert sorted(r.id for r in got.collect()) == list(range(want))


def test_complete_after_restarts(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for run, new in enumerate([3, 4, 0]):
        if new:
            put(spark, src, [("ab"[k % 2], k, 5, "", NOON) for k in range(new)], 1000 + run)
        got = {r.folder: (r.n, r.total) for r in streams.to_table(streams.running_stats(streams.file_stream(spark, src, SCHEMA), "folder", "n"), out).collect()}
        assert got == ({"a": (2, 10), "b": (1, 5)} if run == 0 else {"a": (4, 20), "b": (3, 15)})


def test_nothing_yet(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    got = streams.to_table(streams.file_stream(spark, f"{tmp_path}/in", SCHEMA), f"{tmp_path}/out", "append")
    assert got.count() == 0 and got.columns == ["folder", "id", "n", "part", "ts"]


def budget(spark, tmp_path, limit=50, delay="10 minutes", idle_ms=3_600_000):
    rows = streams.file_stream(spark, f"{tmp_path}/in", SCHEMA)
    out = state.token_budget(rows, F.col("folder"), F.col("id"), F.col("n"), F.col("part"), "ts", limit, delay, idle_ms)
    return streams.to_table(out, f"{tmp_path}/out", "append").collect()


def test_token_budget_holds_across_restarts(spark, tmp_path):
    """Four runs over one checkpoint keep what one running total in order of arrival keeps."""
    rnd, everything, k = random.Random(1), [], 0
    for run in range(4):
        rows = []
        for _ in range(30):
            k += 1
            rows.append((rnd.choice("abc"), k, rnd.randint(0, 9), rnd.choice(["x", "y", None]), NOON + dt.timedelta(seconds=k)))
        rows += [(None, 900 + run, 1, "x", NOON), ("a", None, 1, "x", NOON), ("a", 950 + run, None, "x", NOON)]
        put(spark, f"{tmp_path}/in", rows, 1000 + run)
        everything += rows
        got = budget(spark, tmp_path)
        seen, want = {}, []
        for f, i, n, _, _ in everything:
            if None not in (f, i, n):
                seen[f] = seen.get(f, 0) + n
                if seen[f] <= 50:
                    want.append((f, i, n, seen[f]))
        assert sorted((r.folder, r.id, r.n, r.cum) for r in got) == sorted(want) and not any(r.closed for r in got)
    assert max(seen.values()) > 50


def test_token_budget_late_rows_and_expiry(spark, tmp_path):
    at = lambda h, m=0: NOON + dt.timedelta(hours=h, minutes=m)
    put(spark, f"{tmp_path}/in", [("a", 1, 20, "x", at(0)), ("a", 2, 20, "y", at(0, 5)), ("b", 3, 9, "x", at(0, 30))], 1000)
    assert len(budget(spark, tmp_path)) == 3
    put(spark, f"{tmp_path}/in", [("b", 4, 9, "x", at(1, 20)), ("b", 5, 1, "z", at(0, 25))], 1001)
    budget(spark, tmp_path)
    put(spark, f"{tmp_path}/in", [("b", 6, 1, "y", at(1, 0)), ("a", 7, 10, "x", at(1, 25))], 1002)  # 6 is later than the watermark of 1:10
    got = budget(spark, tmp_path)
    rows = {r.id: r.cum for r in got if not r.closed}
    assert 6 not in rows and rows[4] == 19 and rows[7] == 10  # 5 comes before 4; folder a was closed and began anew
    ended = [r for r in got if r.closed]
    assert [(r.folder, r.n, r.cum, dict(r.parts)) for r in ended] == [("a", 2, 40, {"x": 20, "y": 20})]


@pytest.mark.parametrize("seed,spread,longest,by", [(1, 60, 5, None), (2, 60, 200, None), (3, 10**7, 10**7, None), (4, 40, 30, ["k"])])
def test_overlap_join(spark, seed, spread, longest, by):
    rnd = random.Random(seed)

    def side(name, n):
        return [(rnd.randrange(3), i, lo := rnd.randint(-spread, spread), lo + (rnd.randint(-1, 3) if i % 3 else rnd.randint(0, longest))) for i in range(n)] + [(0, n, None, 5), (None, n + 1, 0, 5), (1, n + 2, -spread, spread * 3)]

    a, b = side("a", 60), side("b", 80)
    one = spark.createDataFrame(a, "k int, a long, a0 long, a1 long")
    other = spark.createDataFrame(b, "k int, b long, b0 long, b1 long")
    if not by:
        one, other = one.drop("k"), other.drop("k")
    out = intervals.overlap_join(one, other, ("a0", "a1"), ("b0", "b1"), by)
    want = sorted((x[1], y[1]) for x in a for y in b if None not in (x[2], y[2]) and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3] and (not by or (x[0] == y[0] and x[0] is not None)))
    assert sorted((r.a, r.b) for r in out.collect()) == want and want
    plan = out._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_overlap_join_of_nothing(spark):
    none = spark.createDataFrame([], "a long, a0 long, a1 long")
    some = spark.createDataFrame([(1, 0, 9)], "b long, b0 long, b1 long")
    assert intervals.overlap_join(none, some, ("a0", "a1"), ("b0", "b1")).count() == 0
    assert intervals.overlap_join(some, none, ("b0", "b1"), ("a0", "a1")).count() == 0


def test_stream_interval_join_drops_late_rows(spark, tmp_path):
    left, right = "k long, a long, at timestamp", "k long, b long, bt timestamp"
    at = lambda m: NOON + dt.timedelta(minutes=m)

    def run():
        x = streams.file_stream(spark, f"{tmp_path}/l", left)
        y = streams.file_stream(spark, f"{tmp_path}/r", right)
        out = streams.interval_pairs(x, y, "k", "at", "bt", "30 MINUTES", "10 minutes")
        return sorted((r.a, r.b) for r in streams.to_table(out, f"{tmp_path}/out", "append").collect())

    put(spark, f"{tmp_path}/l", [(1, 1, at(0)), (2, 2, at(5))], 1000, left)
    put(spark, f"{tmp_path}/r", [(1, 10, at(30)), (1, 11, at(31)), (1, 12, at(-1)), (2, 20, at(5))], 1000, right)
    assert run() == [(1, 10), (2, 20)]
    put(spark, f"{tmp_path}/l", [(1, 3, at(200))], 1001, left)
    put(spark, f"{tmp_path}/r", [(1, 13, at(210))], 1001, right)
    assert run() == [(1, 10), (2, 20), (3, 13)]  # the state goes on after a restart
    put(spark, f"{tmp_path}/l", [(1, 4, at(195)), (2, 5, at(0))], 1002, left)  # 5 is later than the watermark
    put(spark, f"{tmp_path}/r", [(2, 21, at(6))], 1002, right)
    assert run() == [(1, 10), (2, 20), (3, 13), (4, 13)]


@pytest.mark.parametrize("width", [None, 10, 1, 10**6])
def test_asof_join_of_a_hot_key(spark, width):
    """Cells of any width give what one window gives; values carry over cells without rows, and nulls are passed over."""
    from sievework.operators import relational

    rnd = random.Random(9)
    left = [(i, rnd.choice(["hot", "hot", "hot", "a", None]), rnd.randrange(200)) for i in range(300)]
    right = [(rnd.choice(["hot", "hot", "a", None]), t, rnd.choice([t * 10, None])) for t in rnd.sample(range(200), 60)]
    got = relational.asof_join(spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int"), "k", "t", "v", "seen", width)
    want = {i: max(((t2, v) for k2, t2, v in right if k2 == k and t2 <= t and v is not None), default=(0, None))[1] for i, k, t in left}
    assert {r.i: r.seen for r in got.collect()} == want
