"""Batches, shuffles, folder trees, sketches and exports against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievework.operators import batching, tree
from sievework.sources import export


def loop_sizes(n: int, warm: int, start: int, full: int) -> list[int]:
    out, row = [], 0
    while row < n:
        size = min(full, max(start, full * row // warm)) if row < warm else full
        out.append(min(size, n - row))
        row += size
    return out


@pytest.mark.parametrize("warm,start,full", [(500, 2, 20), (500, 20, 20), (37, 1, 100), (5000, 3, 7), (1, 1, 9), (900, 1, 33)])
def test_warm_up_batches(spark, warm, start, full):
    got = batching.warm_up_batches(spark.range(1000), "id", 7, warm, start, full)
    rows = sorted((r.rn, r.batch_no, r.batch_size) for r in got.collect())
    assert [r[0] for r in rows] == list(range(1, 1001))
    n = Counter(b for _, b, _ in rows)
    assert [n[k] for k in range(len(n))] == loop_sizes(1000, warm, start, full)
    assert [b for _, b, _ in rows] == sorted(b for _, b, _ in rows)
    assert all(n[b] == size for _, b, size in rows if b < max(n))
    assert len(batching.warm_up_segments(warm, start, full)) <= full - start + 1


def test_warm_up_of_nothing(spark):
    assert batching.warm_up_batches(spark.range(0), "id", 1, 10, 1, 4).count() == 0
    with pytest.raises(ValueError):
        batching.warm_up_batches(spark.range(3), "id", 1, 10, 5, 4)


def test_distinct_batches(spark):
    """One text with a third of all rows, small groups, single texts and rows without one."""
    rnd = random.Random(2)
    texts = ["hot"] * 100 + [f"t{rnd.randrange(60)}" for _ in range(150)] + [None] * 51
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [(r.id, r.text, r.batch_no) for r in batching.distinct_batches(df, "text", "id", 3, 5).collect()]
    assert len(got) == 300 and len({i for i, _, _ in got}) == 300
    by: dict = {}
    for _, t, b in got:
        by.setdefault(b, []).append(t)
    assert sorted(by) == list(range(100)) and all(len(x) == 3 for x in by.values())
    assert all(len([t for t in x if t]) == len({t for t in x if t}) for x in by.values())
    with pytest.raises(ValueError, match="100 copies"):
        batching.distinct_batches(df, "text", "id", 4, 5)
    assert batching.distinct_batches(df.limit(0), "text", "id", 3, 5).count() == 0


def test_block_shuffle(spark):
    df = spark.range(1000).withColumn("block", F.floor(F.col("id") / 50)).withColumn("row", F.col("id") % 50)
    out = {r.place: (r.block, r.id) for r in batching.block_shuffle(df, "block", "row", 3, 4).collect()}
    assert sorted(out) == list(range(1, 1001)) and len({v[1] for v in out.values()}) == 1000
    for g in range(5):  # each buffer holds four blocks, whole and mixed
        blocks = [out[p][0] for p in range(g * 200 + 1, g * 200 + 201)]
        assert len(set(blocks)) == 4 and blocks != sorted(blocks)
    again = {r.place: (r.block, r.id) for r in batching.block_shuffle(df.repartition(7), "block", "row", 3, 4).collect()}
    assert again == out
    assert {r.place: (r.block, r.id) for r in batching.block_shuffle(df, "block", "row", 4, 4).collect()} != out


def tree_loop(folders, stats):
    """Bottom up, one folder at a time."""
    paths = {"/".join(p.split("/")[:k]) for p in [*folders, *stats] for k in range(len(p.split("/")) + 1)}
    done: dict = {}

    def children(p):
        return [q for q in paths if q and q != p and (q.rsplit("/", 1)[0] if "/" in q else "") == p]

    def visit(p):
        kids = [q for q in children(p)]
        if p in stats:
            done[p] = [(p, stats[p])]
        else:
            for q in kids:
                visit(q)
            got = [done.get(q) for q in kids]
            done[p] = sum(got, []) if kids and all(x is not None for x in got) else None

    visit("")
    return done


def test_tree_totals(spark):
    rnd = random.Random(3)
    folders = ["a", "b/x", "b/y", "c/d/e/f", "c/d/e/g", "c/h", "deep/" + "/".join(str(k) for k in range(12)), "own/one", "own/two"]
    folders += [f"r{rnd.randrange(3)}/s{rnd.randrange(3)}/t{k}" for k in range(20)]
    stats = {f: (rnd.randrange(100), rnd.choice(["", None, f"n-{f}"])) for f in folders if f not in ("b/y", "own/one", "own/two") and not f.startswith("r2")}
    stats["own"] = (1000, "own")  # has an index of its own: what is below does not count
    rows = [(f, n, t) for f, (n, t) in stats.items()]
    got = {r.path: r for r in tree.tree_totals(spark.createDataFrame([(f,) for f in [*folders, *folders[:3], None]], "path string"), spark.createDataFrame([*rows, (None, 1, "x")], "path string, n long, name string")).collect()}
    want = tree_loop(folders, stats)
    assert set(got) == set(want)
    for path, parts in want.items():
        assert got[path].complete == (parts is not None)
        assert got[path].n == (sum(v[0] for _, v in parts) if parts is not None else None)
        names = [v[1] for _, v in sorted(parts or []) if v[1]]
        assert got[path].name == (names[0] if names else None)
    assert not got[""].complete and got["own"].leaves == 1 and got["c"].depth == 1


def test_sketches_merge_in_any_order(spark):
    rnd = random.Random(4)
    rows = [(f"f{k % 12}", rnd.randrange(30_000), int(rnd.lognormvariate(6, 1))) for k in range(60_000)]
    df = spark.createDataFrame(rows, "folder string, item long, n long")
    each = tree.folder_sketches(df, "folder", "item", "n")
    half = tree.merge_sketches(each, [F.substring("folder", 1, 2).alias("folder")])
    for merged in (tree.merge_sketches(each, [F.lit("all").alias("folder")]), tree.merge_sketches(half, [F.lit("all").alias("folder")])):
        r = tree.read_sketches(merged, [10, 50, 99]).first()
        values = sorted(n for _, _, n in rows)
        assert (r.n, r.total, r.least, r.most) == (60_000, sum(values), values[0], values[-1])
        assert abs(r.distinct / len({i for _, i, _ in rows}) - 1) < 0.05
        for p, v in r.percentiles.items():
            rank = sum(x <= v for x in values) / len(values)
            assert abs(rank - int(p) / 100) < 0.03


def test_export_breaks_anywhere(spark, tmp_path, monkeypatch):
    """Broken before, between and after the two writes, and run again: each folder's rows are there once."""
    target = f"{tmp_path}/out"
    df = spark.range(60).withColumn("folder", F.concat(F.lit("f"), F.col("id") % 5))
    first = df.where("id % 5 < 2")
    assert export.export_folders(first, target, "folder", "one") == 2
    write = export.DataFrame.groupBy

    def broken(self, *a):
        raise RuntimeError("killed between data and manifest")

    monkeypatch.setattr(type(df), "groupBy", broken)
    with pytest.raises(RuntimeError):
        export.commit(df.where("id % 5 = 4"), target, "folder", "two")
    monkeypatch.undo()
    assert write is not None and export.exported(spark, target, df.schema).count() == 24  # the broken commit is not seen
    assert export.export_folders(df, target, "folder", "two") == 3
    assert export.export_folders(df, target, "folder", "two") == 3  # repeated under its name
    assert export.export_folders(df, target, "folder", "three") == 0
    assert sorted(r.id for r in export.exported(spark, target, df.schema).collect()) == list(range(60))
    assert all(r.same and r.rows == 12 for r in export.verify(spark, target, df.schema, "folder").collect())


def test_export_stream(spark, tmp_path):
    src, target = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in (0, 1):
        spark.range(part * 10, part * 10 + 10).selectExpr("id", "'g' || id % 3 AS folder").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id long, folder string").option("maxFilesPerTrigger", 1).parquet(src)
        export.export_stream(stream, target, "folder", f"{tmp_path}/state")
    assert sorted(r.id for r in export.exported(spark, target, stream.schema).collect()) == list(range(20))
    assert Counter(r.folder for r in export.manifest(spark, target).collect()) == {"g0": 2, "g1": 2, "g2": 2}
    assert export.exported(spark, f"{tmp_path}/none", stream.schema).count() == 0
