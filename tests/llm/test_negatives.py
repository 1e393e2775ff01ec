"""Hard negatives against brute force, SQL and odd tables."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import entry, negatives

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, step=50, k=5, m=3):
    """rows: (id, vector, label), already without those that take no part; every pair is scored."""
    whole = sorted({(i, tuple(math.floor(256 * x) for x in v), y) for i, v, y in rows})
    out = []

    def dot(a, b):
        return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))

    for i, v, y in whole:
        if i % step == 0:
            scored = sorted((-dot(v, w), j, z) for j, w, z in whole if j != i)
            for s, j, _ in [x for x in scored if x[2] == y][:k]:
                fit = [x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s][:m]
                out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({negatives.ORACLE})").fetchall())
    assert result(entry.op12_negatives(spark, SMALL)) == want and len(want) > 50


@pytest.mark.parametrize("shard,block", [(4096, 2048), (60, 2048), (60, 7)])
def test_against_brute_force(spark, monkeypatch, shard, block):
    """One tree, several, and several blocks of anchors; few small whole components, so that scores tie."""
    monkeypatch.setattr(negatives, "SHARD", shard)
    monkeypatch.setattr(negatives, "ANCHORS", block)
    rnd = random.Random(5)
    rows = [(k, [rnd.randint(-3, 6) / 256 for _ in range(6)], rnd.randint(0, 3)) for k in range(400)]
    rows += [(k, rows[3][1], 2) for k in range(400, 480)]  # a group of copies
    got = result(negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("label"), F.col("vec_id") % 20 == 0))
    assert got == brute(rows, step=20) and len(got) > 100


def test_odd_rows(spark):
    """Nulls, non-finite and huge components, short vectors, repeated rows and ids, clashing columns."""
    rnd = random.Random(6)
    fine = [(k, [float(rnd.randint(1, 9)) for _ in range(3)], k % 2) for k in range(60)]
    fine += [(60, [1e30, 1.0, 0.0], 0), (61, [1e30, 0.0, 2.0], 1), (100, [3e12, 1.0, 2.5], 1), (62, [2.0], 1), (63, [-1e30, 5.0, 5.0], 0)]
    bad = [(None, [1.0, 2.0, 3.0], 1), (64, None, 1), (65, [1.0, None, 2.0], 0), (66, [float("nan"), 1.0, 1.0], 0), (67, [float("inf"), 1.0, 1.0], 0), (68, [1.0, 1.0, 1.0], None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in fine + bad + fine[:7] + [(50, [9.0, 9.0, 1.0], 1)]], "vec_id long, embedding array<double>, label int, rank int, want string")
    got = result(negatives.mine(df, F.col("label"), F.col("vec_id") % 10 == 0))
    assert got == brute([(i, v + [0.0] * (3 - len(v)), y) for i, v, y in [*fine, (50, [9.0, 9.0, 1.0], 1)]], step=10)
    assert any(r[0] == 100 and r[4] > 2**53 for r in got)
    assert result(negatives.mine(df.limit(0), F.col("label"), F.col("vec_id") % 10 == 0)) == []
    assert result(negatives.mine(df.where("label = 1"), F.col("label"), F.col("vec_id") % 10 == 0)) == []  # no other label
    assert result(negatives.mine(df.select("vec_id", "embedding", F.lit(None).cast("int").alias("label")), F.col("label"), F.lit(True))) == []


def test_tree_holds_every_row_and_bounds_hold():
    rnd = np.random.default_rng(2)
    x, y = rnd.normal(size=(500, 5)), rnd.integers(0, 4, 500)
    t = negatives.build(np.arange(500), y, x, leaf=10)
    leaves = [k for k in range(len(t["start"])) if t["left"][k] < 0]
    assert sorted(i for k in leaves for i in range(t["start"][k], t["stop"][k])) == list(range(500))
    assert sorted(t["ids"]) == list(range(500))
    q = rnd.normal(size=5)
    for k in range(len(t["start"])):
        s = t["points"][t["start"][k] : t["stop"][k]] @ q
        r = np.linalg.norm(q) * t["radius"][k] + 1e-9
        assert (abs(s - t["centre"][k] @ q) <= r).all()
        assert set(t["labels"][t["start"][k] : t["stop"][k]]) <= set(range(t["least"][k], t["most"][k] + 1))


def test_balls_are_pruned(monkeypatch):
    """On rows in clusters most leaves are never looked at, and the result is that of all of them."""
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(40, 8)) * 100
    x = np.floor(np.concatenate([c + rnd.normal(size=(100, 8)) for c in centres]))
    t = negatives.build(np.arange(len(x)), np.zeros(len(x), np.int64), x)
    seen = []
    leaf = negatives.Walk.leaf
    monkeypatch.setattr(negatives.Walk, "leaf", lambda self, t, rows, wants: (seen.append(rows), leaf(self, t, rows, wants))[1])
    walk = negatives.Walk(negatives.Block(np.array([-1]), np.array([1]), x[:1], 3, False, np.array([0]), np.array([0]), np.array([2**40])))
    walk.tree(t)
    s = x @ x[0]
    assert list(walk.score[0]) == sorted(s.astype(int), reverse=True)[:3]
    assert len(seen) < sum(k < 0 for k in t["left"]) / 4
