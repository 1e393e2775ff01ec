"""Proposed pairs of near-duplicates settled by their whole texts, pair by pair, in cells of bounded size.

Proposals are of two kinds.  A member may name a pivot; the members around a pivot are cut into blocks of bounded bytes,
and the pivot's text goes to each block.  Other pairs go to the cell of their two blocks, whose texts meet there.
No task holds more than two blocks, or two texts, whatever the size of a group of near-copies.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, stored, tidy
from .graph import connected_components
from .simhash import shingles
from .suffix import _bitmap, _has

#: Bytes of text in a block, or so (or one text).
BLOCK_BYTES = 1 << 20
#: Rows of a cell, named by its two blocks: a node, and its proposed partners in the cell.
CELLS = "xp long, xs long, yp long, ys long, node long, partners array<long>"
#: Proposed pairs without a cell: a node and its partners; rows of a forest (tree) join all nodes that any of the pairs join.
PAIRS = "node long, partners array<long>, tree boolean"


def placed(nodes: DataFrame) -> DataFrame:
    """Nodes (node, pivot, bytes, ...) with their block (home, sub), and whether they are a pivot (centre); stored."""
    named = nodes.withColumn("home", F.coalesce("pivot", "node"))
    room = named.groupBy("home").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("subs"))
    centre = nodes.where("pivot IS NOT NULL").select(F.col("pivot").alias("node"), F.lit(True).alias("centre")).distinct()
    sub = F.when(F.col("subs") > 1, F.pmod(F.xxhash64("node"), F.col("subs"))).otherwise(F.lit(0).cast("long"))
    return stored(named.join(room, "home").withColumn("sub", sub).join(centre, "node", "left"), "placed")


class Texts:
    """The texts of chosen nodes; `nodes` has node, i and th (id and text hash of a row of `docs` with its text)."""

    def __init__(self, docs: DataFrame, rows: DataFrame, nodes: DataFrame):
        self.i, self.th = F.coalesce(F.col("doc_id"), F.lit(NULL_ID)), F.xxhash64(F.lit("row"), "text")
        self.docs, self.nodes = docs, nodes.select("node", "i", "th")
        self.again = rows.groupBy(self.i, "th").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count()  # does a row come twice?

    def of(self, some: DataFrame) -> DataFrame:
        """The rows of `some` (distinct nodes) with their text, stored.

        A filter of a fixed number of bits lets these texts, and a few others, through to the shuffle.
        """
        wanted = stored(self.nodes.join(some, "node"), "wanted")
        key = lambda df: df.withColumn("key", F.xxhash64("i", "th"))
        shared = self.docs.sparkSession.sparkContext.broadcast(_bitmap(key(wanted), "key"))
        src = key(self.docs.select(self.i.alias("i"), self.th.alias("th"), F.col("text").cast("binary").alias("text")))

        def some_rows(batches):
            import pyarrow as pa

            for b in batches:
                yield b.filter(pa.array(_has(shared.value, b.column(3).to_numpy().view(np.uint64))))
            tidy()

        found = src.mapInArrow(some_rows, src.schema).drop("key").join(wanted, ["i", "th"]).drop("i", "th")
        return stored(found.dropDuplicates(["node"]) if self.again else found, "texts")


def star_links(facts: DataFrame, texts: Texts, shingle: int, percent: int) -> DataFrame:
    """(u, v): the true links among the pairs of a node and its pivot."""
    held = texts.of(facts.where("pivot IS NOT NULL OR centre").select("node", "home", "sub", "pivot", "centre"))
    around = held.where("pivot IS NOT NULL").select("home", "sub", "node", F.array("pivot").alias("partners"), "text")
    spread = facts.where("pivot IS NOT NULL").select("home", "sub", F.col("pivot").alias("node")).distinct()
    middle = spread.join(held.where("centre").select("node", "text"), "node").select("home", "sub", "node", F.array().cast("array<long>").alias("partners"), "text")
    return _links(around.unionByName(middle), ["home", "sub"], shingle, percent)


def pair_links(found: DataFrame, texts: Texts, shingle: int, percent: int) -> DataFrame:
    """(u, v): true links that join all that the proposals CELLS join truly, a spanning forest of each cell."""
    cells = stored(found.groupBy("xp", "xs", "yp", "ys", "node").agg(F.flatten(F.collect_list("partners")).alias("partners")), "cells")  # the nodes of a block at most
    return _links(cells.join(texts.of(cells.select("node").distinct()), "node"), ["xp", "xs", "yp", "ys"], shingle, percent)


def cells(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of CELLS for the rows PAIRS, of nodes (node, bytes): nodes that pairs join have one home, cut into blocks of bounded bytes."""
    home = connected_components(found.where("tree").select(F.col("node").alias("u"), F.explode("partners").alias("v"))).withColumnRenamed("root", "home")
    room = home.join(nodes.select("node", "bytes"), "node").groupBy("home").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("subs"))
    sub = lambda c: F.when(F.col("subs") > 1, F.pmod(F.xxhash64(c), F.col("subs"))).otherwise(F.lit(0).cast("long"))
    pair = found.where("NOT tree").join(home.join(room, "home"), "node").select("home", "subs", "node", sub("node").alias("s"), F.explode("partners").alias("p")).withColumn("t", sub("p"))
    none = F.array().cast("array<long>")
    both = F.array(F.struct("node", F.array("p").alias("partners")), F.struct(F.col("p").alias("node"), none.alias("partners")))
    return pair.select(F.col("home").alias("xp"), F.least("s", "t").alias("xs"), F.col("home").alias("yp"), F.greatest("s", "t").alias("ys"), F.explode(both).alias("b")).select("xp", "xs", "yp", "ys", "b.*")


def no_cells() -> pd.DataFrame:
    return pd.DataFrame(columns=["xp", "xs", "yp", "ys", "node", "partners"], dtype=object)


def as_cells(home: np.ndarray, node: np.ndarray, x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    """The pairs of the rows x and y as rows of CELLS; home has the block (two columns) of each row, node its node."""
    names, block = np.unique(home, axis=0, return_inverse=True)
    block = block.ravel()
    x, y = np.where(block[x] <= block[y], x, y), np.where(block[x] <= block[y], y, x)
    order = np.lexsort((x, block[y], block[x]))
    x, y = x[order], y[order]
    cell = np.stack([block[x], block[y]])
    begin = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (cell[:, 1:] != cell[:, :-1]).any(axis=0)))
    lists = np.split(node[y], begin[1:])
    others = np.unique(np.stack([block[x], block[y], y]), axis=1)
    ab, u = np.concatenate([cell[:, begin], others[:2]], axis=1), np.concatenate([x[begin], others[2]])
    out = pd.DataFrame(np.concatenate([names[ab[0]], names[ab[1]], node[u][:, None]], axis=1), columns=["xp", "xs", "yp", "ys", "node"])
    out["partners"] = [*lists, *[[]] * len(others[0])]
    return out


def _links(cells: DataFrame, key: list[str], shingle: int, percent: int) -> DataFrame:
    return cells.groupBy(*key).applyInPandas(partial(_confirm_cell, shingle=shingle, percent=percent), "u long, v long")


def _confirm_cell(pdf: pd.DataFrame, shingle: int, percent: int) -> pd.DataFrame:
    return confirm(pdf, shingle, percent)


def confirm(pdf: pd.DataFrame, shingle: int, percent: int) -> pd.DataFrame:
    """(u, v): a spanning forest of the true links of a cell, whose rows are (node, partners, text).

    Shingles are compared themselves, not by hashes; of pairs that links join already nothing is compared.
    """
    number: dict[bytes, int] = {}
    at, members = {}, []
    wanted: dict[int, set] = {}
    for node, partners, text in zip(pdf["node"], pdf["partners"], pdf["text"]):
        if node not in at:
            at[node] = len(members)
            members.append(np.array([number.setdefault(s, len(number)) for s in set(shingles(text or b"", shingle))], np.int64))
        wanted.setdefault(at[node], set()).update(partners)
    n = np.array([len(m) for m in members], np.int64)
    parent = np.arange(len(members))
    links, names = [], list(at)
    mark = np.zeros(len(number) + 1, bool)
    for x, partners in wanted.items():
        y = np.array(sorted(at[p] for p in partners), np.int64)
        y = y[parent[y] != parent[x]]
        y = y[n[y] > 0] if n[x] else y[:0]
        if not len(y):
            continue
        mark[members[x]] = True
        both = np.add.reduceat(mark[np.concatenate([members[k] for k in y])], np.cumsum(n[y]) - n[y], dtype=np.int64)
        mark[members[x]] = False
        for k in y[100 * both >= percent * (n[x] + n[y] - both)]:
            if parent[k] != parent[x]:
                links.append((names[x], names[k]))
                parent[parent == parent[k]] = parent[x]
    return pd.DataFrame(links, columns=["u", "v"])
