"""Exact inner-product top-k by the three-phase uniform threshold.

A node holds a range of the dimensions of all candidates, in shards.  Phase 1 gathers each node's best
partial scores; the exact scores of these few give each query a safe cutoff.  Phase 2 broadcasts the
cutoff, shared equally among the nodes, and collects every entry that reaches its share at some node: what
reaches it nowhere cannot be among the best.  Phase 3 drops entries whose upper bound is below the best
exact scores so far and fetches the missing partial scores of the rest.  Queries go out in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored, tidy

#: Ranges of dimensions, queries in a block (whose vectors are broadcast), candidates in a shard, and queries scored at once.
NODES, QUERY_BLOCK, SHARD, ROWS = 2, 4096, 4096, 512


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k best scores, ties to the first column."""
    n = score.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(score), 1))
    edge = np.partition(score, n - k, axis=1)[:, n - k]
    rows = []
    for s, e in zip(score, edge):
        at = np.flatnonzero(s >= e)
        rows.append(at[np.lexsort((at, -s[at]))][:k])
    return np.stack(rows)


def _candidates(rows: DataFrame, k: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Packed shards (shard, node, start, width, mat, ids, n_ids) and members (shard, pos, ids).

    A candidate is a distinct vector with its k + 1 smallest ids: no other of its ids can be among the k
    best of a query, whose own id may be one of them.  The limit is applied before the shuffle too.
    """
    w = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    few = stored(few, "candidates")
    shards = max(1, -(-few.count() // SHARD))
    edges = np.linspace(0, width, NODES + 1).astype(int)

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(least=[int(x[0]) for x in pdf["ids"]], key=[np.asarray(v, np.int64).tobytes() for v in pdf["v"]]).sort_values(["least", "key"])
        m = np.stack([np.asarray(v, np.int64) for v in pdf["v"]])
        ids = np.zeros((len(pdf), k + 1), np.int64)
        for i, x in enumerate(pdf["ids"]):
            ids[i, : len(x)] = x
        n = np.array([len(x) for x in pdf["ids"]], np.int64)
        return pd.DataFrame([(key[0], node, int(a), int(b - a), np.ascontiguousarray(m[:, a:b]).tobytes(), ids.tobytes(), n.tobytes()) for node, (a, b) in enumerate(zip(edges[:-1], edges[1:]))], columns=["shard", "node", "start", "width", "mat", "ids", "n_ids"])

    packed = few.groupBy(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard")).applyInPandas(pack, "shard int, node int, start int, width int, mat binary, ids binary, n_ids binary")
    packed = cut(packed.repartition(max(1, shards * NODES // 4), "shard", "node"))  # a few megabytes in a partition

    def list_members(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                n, ids = np.frombuffer(r.n_ids, np.int64), np.frombuffer(r.ids, np.int64).reshape(-1, k + 1)
                yield pd.DataFrame({"shard": r.shard, "pos": np.arange(len(n)), "ids": [x[:c] for x, c in zip(ids, n)]})

    return packed, packed.where("node = 0").mapInPandas(list_members, "shard int, pos int, ids array<long>")


class _Block:
    """A block of queries for the executors: ids, vectors and, from phase 2 on, each node's share of the cutoff."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, kind: type, k: int, shares: np.ndarray | None = None):
        self.ids, self.vectors, self.kind, self.k, self.shares = ids, vectors, kind, k, shares

    def scores(self, pdf: pd.DataFrame) -> Iterator[tuple]:
        """(row, first query, partial scores, pairs of a query with nothing but itself) of the shards in `pdf`."""
        for r in pdf.itertuples():
            c = np.frombuffer(r.mat, np.int64).reshape(-1, r.width).astype(self.kind) if r.width else np.zeros((len(r.n_ids) // 8, 0), self.kind)
            q = self.vectors[:, r.start : r.start + r.width].astype(self.kind)
            one = np.frombuffer(r.n_ids, np.int64) == 1
            least = np.frombuffer(r.ids, np.int64).reshape(-1, self.k + 1)[:, 0]
            for a in range(0, len(q), ROWS):
                yield r, a, q[a : a + ROWS] @ c.T, one & (least == self.ids[a : a + ROWS, None])


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates by integer inner product.

    Components are floor(256 * x).  Rows with a null id or vector, or a null or non-finite component, take
    no part; equal rows count once; candidates are all ids but the query's own, ties go to the smaller
    id; a shorter vector counts as filled up with zeros; other columns are left out; an empty table gives
    an empty result.  Vectors so large that an inner product might leave 64 bits raise a ValueError.
    """
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fine = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 256).alias("x"))
    size = fine.agg(F.max(F.size("x")).alias("width"), F.max(F.array_max(F.transform("x", lambda x: F.abs(x)))).alias("most")).first()
    width, most = max(size.width or 0, 1), float(size.most or 0.0) + 1
    if most * most * width >= 2.0**62:
        raise ValueError(f"components up to {most:.3g} in {width} dimensions: an inner product might leave 64 bits")
    kind = np.float64 if most * most * width < 2.0**52 else np.int64  # exact either way
    rows = cut(fine.select("vec_id", F.concat(F.transform("x", lambda x: F.floor(x)), F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("v")).distinct())
    queries = rows.where(is_query)
    blocks = -(-queries.count() // QUERY_BLOCK)
    if not blocks:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    packed, members = _candidates(rows, k, width)
    out = None
    for b in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)) == b).orderBy("vec_id", "v").collect()  # about QUERY_BLOCK rows
        if got:
            found = _search_block(packed, _Block(np.array([r.vec_id for r in got], np.int64), np.array([r.v for r in got], np.int64), kind, k))
            # a vector's ids but the query's own, and the best of these
            ids = found.join(members, ["shard", "pos"]).select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id").distinct()
            part = ids.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            part = part if blocks == 1 else stored(part, "topk")
            out = part if out is None else out.unionByName(part)
    return out


def _search_block(packed: DataFrame, block: _Block) -> DataFrame:
    """(query_id, shard, pos, score): for each query of the block its k best candidate vectors at least, with ties."""
    spark, k, m = packed.sparkSession, block.k, len(block.ids)
    sc = spark.sparkContext
    shared = sc.broadcast(block)

    def first(batches):
        b = shared.value
        for pdf in batches:
            for r, a, s, own in b.scores(pdf):
                low = s.min(axis=1)
                at = _best(np.where(own, low[:, None] - 1, s), k)
                on = ~np.take_along_axis(own, at, axis=1).ravel()
                yield pd.DataFrame({"qi": np.repeat(np.arange(a, a + len(s)), at.shape[1])[on], "node": r.node, "shard": r.shard, "pos": at.ravel()[on], "part": np.take_along_axis(s, at, axis=1).astype(np.int64).ravel()[on]})
                yield pd.DataFrame({"qi": np.arange(a, a + len(s)), "node": r.node, "shard": r.shard, "pos": -1, "part": low.astype(np.int64)})
        tidy()

    # phase 1: the local lists and least partial scores; exact scores of what the lists hold give the cutoff
    lists = cut(packed.mapInPandas(first, "qi int, node int, shard int, pos int, part long"))
    best = lists.where("pos >= 0").withColumn("r", F.row_number().over(Window.partitionBy("qi", "node").orderBy(F.desc("part"), "shard", "pos"))).where(F.col("r") <= k)
    probe = best.select("qi", "shard", "pos").distinct()
    exact = _fetch(packed, shared, probe.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(NODES - 1))))).groupBy("qi", "shard", "pos").agg(F.sum("part").alias("score"))
    tau = np.full(m, np.iinfo(np.int64).min // 4)
    for r in _kth(exact, k).collect():  # at most one row for each query of the block
        tau[r.qi] = r.score
    low = np.zeros((m, NODES), np.int64)
    for r in lists.where("pos < 0").groupBy("qi", "node").agg(F.min("part").alias("low")).collect():  # NODES for each query
        low[r.qi, r.node] = r.low
    shares = low + np.maximum((tau - low.sum(axis=1)) // NODES, 0)[:, None]

    # phase 2: every entry that reaches its node's share
    block.shares = shares
    shared2 = sc.broadcast(block)

    def second(batches):
        b = shared2.value
        for pdf in batches:
            for r, a, s, own in b.scores(pdf):
                x, y = np.nonzero((s >= b.shares[a : a + len(s), r.node, None]) & ~own)
                yield pd.DataFrame({"qi": x + a, "shard": r.shard, "pos": y, "node": r.node, "part": s[x, y].astype(np.int64)})
        tidy()

    entries = packed.mapInPandas(second, "qi int, shard int, pos int, node int, part long")
    known = cut(entries.groupBy("qi", "shard", "pos").agg(F.sum("part").alias("known"), F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("node"))).alias("have")))
    full = (1 << NODES) - 1
    complete = known.where(F.col("have") == full).select("qi", "shard", "pos", F.col("known").alias("score"))

    # phase 3: bounds against the best exact scores so far, and what is still open is fetched
    limits = spark.createDataFrame([(i, int(tau[i]), [int(x) for x in shares[i]]) for i in range(m)], "qi int, tau long, shares array<long>")  # one row for each query of the block
    limits = limits.join(_kth(complete, k).select("qi", F.col("score").alias("better")), "qi", "left").select("qi", F.greatest("tau", F.coalesce("better", "tau")).alias("tau"), "shares")
    absent = F.filter(F.sequence(F.lit(0), F.lit(NODES - 1)), lambda n: F.col("have").bitwiseAND(F.call_function("shiftleft", F.lit(1), n)) == 0)
    rest = known.where(F.col("have") != full).join(F.broadcast(limits), "qi").withColumn("absent", absent)
    rest = rest.where(F.col("known") + F.aggregate("absent", F.lit(0).cast("long"), lambda s, n: s + F.element_at("shares", n + 1) - 1) >= F.col("tau"))
    open_parts = _fetch(packed, shared, rest.select("qi", "shard", "pos", F.explode("absent").alias("node")))
    resolved = rest.select("qi", "shard", "pos", F.col("known").alias("part")).unionByName(open_parts).groupBy("qi", "shard", "pos").agg(F.sum("part").alias("score"))
    every = complete.unionByName(resolved).withColumn("r", F.rank().over(Window.partitionBy("qi").orderBy(F.desc("score")))).where(F.col("r") <= k)
    names = spark.createDataFrame([(i, int(x)) for i, x in enumerate(block.ids)], "qi int, query_id long")
    return cut(every.join(F.broadcast(names), "qi").select("query_id", "shard", "pos", "score"))


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """The k-th best row of each query that has so many."""
    return scores.withColumn("r", F.row_number().over(Window.partitionBy("qi").orderBy(F.desc("score")))).where(F.col("r") <= k).where(F.col("r") == k)


def _fetch(packed: DataFrame, shared, pairs: DataFrame) -> DataFrame:
    """(qi, shard, pos, part) of pairs (qi, shard, pos, node): the places travel to their shard in lists of bounded size."""
    code = F.shiftleft(F.col("qi").cast("long"), 32) + F.col("pos")
    lists = pairs.groupBy("shard", "node", F.floor(F.col("qi") / ROWS).alias("g")).agg(F.collect_list(code).alias("codes"))  # ROWS * SHARD at most

    def fetch(batches):
        b = shared.value
        for pdf in batches:
            for r in pdf.itertuples():
                code = np.asarray(r.codes, np.int64)
                qi, pos = code >> 32, code & 0xFFFFFFFF
                c = np.frombuffer(r.mat, np.int64).reshape(-1, r.width) if r.width else np.zeros((int(pos.max()) + 1, 0), np.int64)
                for a in range(0, len(code), 65_536):
                    x, y = qi[a : a + 65_536], pos[a : a + 65_536]
                    yield pd.DataFrame({"qi": x, "shard": r.shard, "pos": y, "part": np.einsum("ij,ij->i", b.vectors[x, r.start : r.start + r.width], c[y])})
        tidy()

    return packed.select("shard", "node", "start", "width", "mat").join(lists, ["shard", "node"]).mapInPandas(fetch, "qi int, shard int, pos int, part long")


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
) SELECT * FROM r WHERE rank <= 5
"""
