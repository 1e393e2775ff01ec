"""Hard negatives by ball trees: exact branch and bound on inner products inside a window of scores.

The rows are dealt into shards, each with a tree of balls.  For an anchor q a ball of centre c and radius r holds
inner products from q.c - |q| r to q.c + |q| r only.  A pass over the shards finds the anchors' positives; a second one
finds each positive's negatives: a ball goes where its bounds lie outside the window, or strictly beneath the
current k-th score.  Both passes walk a tree with a block of anchors at once, all vectors of a leaf in one product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored, tidy

#: Rows of a shard, rows of a leaf, anchors in a block (whose vectors are broadcast).
SHARD, LEAF, ANCHORS = 4096, 64, 2048
#: Scores that a long cannot hold count as its nearest end.
LEAST, MOST = -(2**63), 2**63 - 1

TREE = "shard int, ids binary, labels binary, points binary, start binary, stop binary, left binary, right binary, centre binary, radius binary, least binary, most binary"
KINDS = {"ids": np.int64, "labels": np.int64, "points": np.float64, "start": np.int32, "stop": np.int32, "left": np.int32, "right": np.int32, "centre": np.float64, "radius": np.float64, "least": np.int64, "most": np.int64}


def build(ids: np.ndarray, labels: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> dict:
    """A ball tree of the points: nodes of several labels are cut between labels, others between distant points.

    A node covers the points from start to stop; left and right are -1 in a leaf; least and most are its labels.
    """
    order = np.lexsort((ids, labels))
    nodes: list[list] = []
    centres = []
    todo = [(0, len(ids), None)]
    while todo:
        a, b, parent = todo.pop()
        at = order[a:b]
        x, y = points[at], labels[at]
        c = x.mean(axis=0)
        here = len(nodes)
        if parent is not None:
            nodes[parent][3 if nodes[parent][2] >= 0 else 2] = here
        far = np.sqrt(((x - c) ** 2).sum(axis=1))
        nodes.append([a, b, -1, -1, far.max() * (1 + 1e-9), y.min(), y.max()])
        centres.append(c)
        if b - a <= leaf or not far.any() and y[0] == y[-1]:
            continue
        if y[0] != y[-1]:
            cuts = np.flatnonzero(y[1:] != y[:-1]) + 1
            mid = a + int(cuts[np.argmin(np.abs(cuts - (b - a) // 2))])
        else:
            one = x[np.argmax(far)]
            other = x[np.argmax(((x - one) ** 2).sum(axis=1))]
            side = (x - c) @ (other - one)
            mid = a + (b - a) // 2
            order[a:b] = at[np.argsort(side, kind="stable")]
        todo += [(mid, b, here), (a, mid, here)]
    start, stop, left, right, radius, least, most = zip(*nodes)
    return {"ids": ids[order], "labels": labels[order], "points": points[order], "start": start, "stop": stop, "left": left, "right": right, "centre": np.stack(centres), "radius": radius, "least": least, "most": most}


class Block:
    """A block of anchors: ids, labels and vectors, and what is wanted of them, a row for each want.

    A want has an owner (an anchor), and may have a window of scores; `same` wants rows of the anchor's label, else
    rows of others.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int, same: bool, owner: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None):
        self.ids, self.labels, self.vectors, self.k, self.same = ids, labels, vectors, k, same
        self.owner, self.low, self.high = owner, low, high


class Walk:
    """The best rows so far of every want; one Walk goes through all the shards of a task."""

    def __init__(self, block: Block):
        self.b, n, k = block, len(block.owner), block.k
        self.score, self.id, self.ok = np.full((n, k), LEAST, np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool)
        self.norm = np.sqrt((block.vectors**2).sum(axis=1))
        self.size = np.abs(block.vectors).max(axis=1, initial=0)

    def tree(self, t: dict) -> None:
        b = self.b
        todo = [(0, np.arange(len(b.owner)))]
        while todo:
            node, wants = todo.pop()
            label = b.labels[b.owner[wants]]
            if b.same:
                wants = wants[(t["least"][node] <= label) & (label <= t["most"][node])]
            elif t["least"][node] == t["most"][node]:
                wants = wants[label != t["least"][node]]
            if not len(wants):
                continue
            own, at = np.unique(b.owner[wants], return_inverse=True)
            c, r = t["centre"][node], t["radius"][node]
            dot, slack = b.vectors[own] @ c, self.norm[own] * (r + 1e-9 * (np.sqrt(c @ c) + r)) + 1  # the last two for rounding
            upper, lower = (dot + slack)[at], (dot - slack)[at]
            on = ~self.ok[wants, -1] | (upper >= self.score[wants, -1])
            if b.low is not None:
                on &= (upper >= b.low[wants]) & (lower <= b.high[wants])
            wants = wants[on]
            if not len(wants):
                continue
            if t["left"][node] < 0:
                self.leaf(t, slice(t["start"][node], t["stop"][node]), wants)
            else:  # the child that promises more goes first
                kids = sorted((t["left"][node], t["right"][node]), key=lambda k: (b.vectors[own] @ t["centre"][k]).sum())
                todo += [(k, wants) for k in kids]

    def leaf(self, t: dict, rows: slice, wants: np.ndarray) -> None:
        b = self.b
        own, at = np.unique(b.owner[wants], return_inverse=True)
        ids = t["ids"][rows]
        score = self.products(own, t["points"][rows])
        fits = (t["labels"][rows] == b.labels[own, None]) == b.same
        fits &= ids != b.ids[own, None]
        score, fits = score[at], fits[at]
        fits &= ~self.ok[wants, -1, None] | (score >= self.score[wants, -1, None])
        if b.low is not None:
            fits &= (score >= b.low[wants, None]) & (score <= b.high[wants, None])
        some = fits.any(axis=1)
        if not some.any():
            return
        w = wants[some]
        score = np.concatenate([self.score[w], score[some]], axis=1)
        fits = np.concatenate([self.ok[w], fits[some]], axis=1)
        ids = np.concatenate([self.id[w], np.broadcast_to(ids, (len(w), len(ids)))], axis=1)
        best = np.lexsort((ids, ~score, ~fits), axis=1)[:, : b.k]  # ~ turns the order round and cannot overflow
        self.score[w], self.id[w], self.ok[w] = (np.take_along_axis(x, best, axis=1) for x in (score, ids, fits))

    def products(self, own: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Exact inner products as longs: in doubles where these hold them all, else in integers of any size."""
        safe = self.size[own] * np.abs(points).max(initial=0) * max(1, points.shape[1]) < 2.0**52
        out = np.zeros((len(own), len(points)), np.int64)
        out[safe] = (self.b.vectors[own[safe]] @ points.T).astype(np.int64)
        if not safe.all():
            whole = np.frompyfunc(int, 1, 1)
            exact = whole(self.b.vectors[own[~safe]]).reshape(-1, points.shape[1]) @ whole(points).T
            out[~safe] = np.frompyfunc(lambda x: max(LEAST, min(MOST, x)), 1, 1)(exact)
        return out


def shards(rows: DataFrame, width: int) -> DataFrame:
    """Ball trees of the rows (vec_id, label, v), SHARD rows or so in each, stored."""
    many = max(1, -(-rows.count() // SHARD))

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.array(list(pdf["v"]), np.float64).reshape(len(pdf), width)
        t = build(pdf["vec_id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64), points)
        return pd.DataFrame([{"shard": key[0], **{k: np.ascontiguousarray(t[k], kind).tobytes() for k, kind in KINDS.items()}}])

    return stored(rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(many)).cast("int").alias("shard")).applyInPandas(pack, TREE), "balls")


def _passes(trees: DataFrame, block: Block, width: int) -> DataFrame:
    """(want, vec_id, score): each task's best rows for every want of the block."""
    shared = trees.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = Walk(shared.value)
        for pdf in batches:
            for r in pdf.to_dict("records"):
                t = {k: np.frombuffer(r[k], kind) for k, kind in KINDS.items()}
                t |= {"points": t["points"].reshape(len(t["ids"]), width), "centre": t["centre"].reshape(-1, width)}
                walk.tree(t)
        at = np.nonzero(walk.ok)
        yield pd.DataFrame({"want": at[0], "vec_id": walk.id[at], "score": walk.score[at]})
        tidy()

    best = trees.mapInPandas(run, "want int, vec_id long, score long")
    w = Window.partitionBy("want").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= block.k)


def mine(vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, ...).

    Components are floor(256 * x), scores integer inner products with the anchor; higher scores come first, ties by smaller
    id.  An anchor's positives are its first `positives` other rows of the same label; for each, the first
    `negatives` rows of other labels with low * positive <= 100 * negative <= high * positive are returned.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; equal rows count once;
    other rows are those of another id; a shorter vector counts as filled up with zeros; a score that a long cannot
    hold counts as its nearest end; an anchor without positives, or a positive without negatives, gives no row; an
    empty table gives an empty result; other columns of any name are left out.
    """
    spark = vectors.sparkSession
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    named = vectors.select("vec_id", "embedding", label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    fine = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & good)
    scaled = lambda x: x.cast("double") * 256
    whole = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))  # doubles beyond have no fraction
    rows = cut(fine.select("vec_id", "label", "anchor", whole.alias("v")).distinct())
    width = rows.agg(F.max(F.size("v")).alias("w")).first().w or 0
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    anchors = rows.where("anchor")
    blocks = -(-anchors.count() // ANCHORS)
    trees = shards(rows, width) if blocks else None
    out = None
    for k in range(blocks):
        got = anchors.where(F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)) == k).orderBy("vec_id", "label", "v").collect()  # about ANCHORS rows
        if got:
            part = _mine_block(trees, got, width, positives, negatives, low, high)
            part = part if blocks == 1 else stored(part, "negatives")
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long") if out is None else out


def _mine_block(trees: DataFrame, got: list, width: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    ids, labels = np.array([r.vec_id for r in got], np.int64), np.array([r.label for r in got], np.int64)
    q = np.array([r.v for r in got], np.float64).reshape(len(got), width)
    every = np.arange(len(got))
    found = _passes(trees, Block(ids, labels, q, positives, True, every), width).orderBy("want", "rank").collect()  # `positives` for each anchor of the block
    # the whole numbers in the window, as integers of any size
    spans = [(r.want, r.vec_id, r.score, -(-low * r.score // 100), high * r.score // 100) for r in found]
    spans = [s for s in spans if s[3] <= s[4]]
    bound: Callable[[int], np.ndarray] = lambda j: np.array([max(LEAST, min(MOST, s[j])) for s in spans], np.int64)
    wanted = Block(ids, labels, q, negatives, False, np.array([s[0] for s in spans], np.int64), bound(3), bound(4))
    best = _passes(trees, wanted, width)
    names = trees.sparkSession.createDataFrame([(i, int(ids[s[0]]), s[1], s[2]) for i, s in enumerate(spans)], "want int, anchor_id long, positive_id long, positive_score long")  # a row for each want
    return best.join(F.broadcast(names), "want").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
) SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
