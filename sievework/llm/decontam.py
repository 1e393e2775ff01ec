"""Benchmark decontamination by greedy string tiling.

Documents and items that share a run of SEED words (found by a rolling hash, then compared word by word)
are tiled: the longest common run that touches no marked word is marked in both, again and again.  An
item counts as contained if the marked share of its words reaches a threshold, in whatever order its
passages stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_rows, stored, tidy

WORD = re.compile(r"[^\W_]+")
SEED = 5
#: Pairs of equal seeds of a text that are listed; beyond, tiles are found without a list (with the same result).
PAIRS = 200_000
_BASE = np.uint64(0x100000001B3)


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin value of every run of n numbers."""
    h = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    u = ids.astype(np.uint64)
    for k in range(n):
        h = h * _BASE + u[k : k + len(h)]
    return h


class Items:
    """Benchmark items as word numbers, and the sorted table of their seeds."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.vocabulary: dict[str, int] = {}
        put = self.vocabulary.setdefault
        self.item_id = [i for i, _ in rows]
        self.words = [np.array([put(w, len(self.vocabulary) + 1) for w in WORD.findall(t.lower())], np.int64) for _, t in rows]
        found: dict[int, list] = {}
        for k, w in enumerate(self.words):
            n = min(SEED, len(w))
            if n:
                h = rolling(w, n)
                found.setdefault(n, []).append((h, np.full(len(h), k), np.arange(len(h))))
        self.seeds = {}
        for n, parts in found.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts))
            o = np.argsort(h, kind="stable")
            self.seeds[n] = h[o], item[o], at[o]

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
        """(item, seed length, places in the item, places in the document) of all equal seeds.

        Where the seeds repeat so often that there are over PAIRS pairs of places, those in the document are
        None and those in the item each stand once: memory stays within that, the table and the text.
        """
        for n, (table, item, at) in self.seeds.items():
            if len(ids) < n:
                continue
            known = np.concatenate([[0], np.cumsum(ids > 0)])
            start = np.flatnonzero(known[n:] - known[:-n] == n)  # only words of the benchmark
            if not len(start):
                continue
            h = rolling(ids, n)[start]
            lo, hi = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
            some = hi > lo
            start, lo, count = start[some], lo[some], (hi - lo)[some]
            if not len(start):
                continue
            if count.sum() > PAIRS:
                _, one = np.unique(lo, return_index=True)  # equal seeds have the same part of the table
                lo, count = lo[one], count[one]
                row = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
                k, p = item[row], at[row]
                o = np.lexsort((p, k))
                k, p = k[o], p[o]
                cut = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k))
                for a, b in zip(cut[:-1], cut[1:]):
                    yield int(k[a]), n, p[a:b], None
                continue
            row = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
            t = np.repeat(start, count)
            k, p = item[row], at[row]
            o = np.argsort(k, kind="stable")
            k, p, t = k[o], p[o], t[o]
            cut = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k))
            for a, b in zip(cut[:-1], cut[1:]):
                w = self.words[k[a]]
                same = np.all([w[p[a:b] + j] == ids[t[a:b] + j] for j in range(n)], axis=0)
                if same.any():
                    yield int(k[a]), n, p[a:b][same], t[a:b][same]


def tile(p: np.ndarray, t: np.ndarray, n: int, item_words: int, doc_words: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the document, words) from the equal seeds of n words.

    Longest first; of equally long ones the first in the item, then in the document.
    """
    tiles = []
    free_p, free_t = np.ones(item_words, bool), np.ones(doc_words, bool)
    o = np.lexsort((p, t - p))
    p, t = p[o], t[o]
    while len(p):
        first = np.flatnonzero(np.append(True, (np.diff(t - p) != 0) | (np.diff(p) != 1)))
        size = np.diff(np.append(first, len(p))) + n - 1
        best = np.lexsort((t[first], p[first], -size))[0]
        a, b, m = int(p[first[best]]), int(t[first[best]]), int(size[best])
        tiles.append((a, b, m))
        free_p[a : a + m] = False
        free_t[b : b + m] = False
        if not free_p.any():
            break
        gone_p, gone_t = np.append(0, np.cumsum(~free_p)), np.append(0, np.cumsum(~free_t))
        keep = (gone_p[p + n] == gone_p[p]) & (gone_t[t + n] == gone_t[t])
        p, t = p[keep], t[keep]
    return tiles


def tile_long(w: np.ndarray, ids: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """tile() from the words themselves, for texts whose equal seeds are too many to list.

    The length of the longest common run of free words is found by halving (a run has all shorter ones in
    it), with a rolling hash of all runs of a length and a comparison word by word; memory is that of the
    two texts.  A longest run that is left after a mark is no longer than before.
    """
    w, ids = w.copy(), ids.copy()
    tiles, most = [], min(len(w), len(ids))

    def common(size: int) -> tuple[int, int] | None:
        """First place in the item, then in the document, of equal runs of `size` free words."""
        if size > most:
            return None
        ok_w = np.flatnonzero(_run_sums(w <= 0, size) == 0)
        ok_t = np.flatnonzero(_run_sums(ids <= 0, size) == 0)
        hw, ht = _powers(w, size)[ok_w], _powers(ids, size)[ok_t]
        order = np.argsort(ht, kind="stable")
        at = np.searchsorted(ht[order], hw, "left")
        for k in np.flatnonzero((at < len(ht)) & (ht[order][np.minimum(at, len(ht) - 1)] == hw) if len(ht) else np.zeros(len(hw), bool)):
            j = at[k]
            while j < len(order) and ht[order[j]] == hw[k]:
                a, b = int(ok_w[k]), int(ok_t[order[j]])
                if np.array_equal(w[a : a + size], ids[b : b + size]):
                    return a, b
                j += 1
        return None

    while most >= n:
        lo, hi, found = n - 1, most, None
        while lo < hi:
            mid = (lo + hi + 1) // 2
            got = common(mid)
            lo, hi, found = (mid, hi, got) if got else (lo, mid - 1, found)
        if found is None:
            break
        (a, b), most = found, lo
        tiles.append((a, b, lo))
        w[a : a + lo], ids[b : b + lo] = 0, 0
    return tiles


def _run_sums(x: np.ndarray, size: int) -> np.ndarray:
    total = np.append(0, np.cumsum(x))
    return total[size:] - total[:-size]


def _powers(ids: np.ndarray, size: int) -> np.ndarray:
    """rolling(), in a number of steps that grows with the logarithm of the length."""
    h, n, out, have, left = ids.astype(np.uint64), 1, None, 0, size
    factor = np.array([_BASE])  # an array, whose products wrap without a warning
    while left:
        if left & 1:
            out, have = (h, n) if out is None else (out[: len(h) - have] * factor + h[have:], have + n)
        left >>= 1
        if left:
            h, factor, n = h[:-n] * factor + h[n:], factor * factor, 2 * n
    return out[: max(0, len(ids) - size + 1)]


def matches(text: str, items: Items, threshold: float) -> list[tuple]:
    """(item id, coverage, tiles) of every item whose tiled share in the text reaches the threshold."""
    get = items.vocabulary.get
    ids = np.array([get(w, 0) for w in WORD.findall(text.lower())], np.int64)
    out = []
    for k, n, p, t in items.hits(ids):
        size = len(items.words[k])
        if t is None:
            if _covered(p, n, size) >= threshold * size:
                found = tile_long(items.words[k], ids, n)
                share = sum(m for _, _, m in found) / size
                if share >= threshold:
                    out.append((items.item_id[k], share, found))
            continue
        if len(np.unique(p)) + n - 1 < threshold * size and _covered(p, n, size) < threshold * size:
            continue  # even overlapping tiles could not reach it
        found = tile(p, t, n, size, len(ids))
        share = sum(m for _, _, m in found) / size
        if share >= threshold:
            out.append((items.item_id[k], share, found))
    return out


def _covered(p: np.ndarray, n: int, size: int) -> int:
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, p, 1)
    np.add.at(marks, p + n, -1)
    return int((np.cumsum(marks)[:size] > 0).sum())


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[Items]:
    """The benchmark in blocks of about `block_chars` characters, one after the other."""
    rows, size = [], 0
    for r in benchmark.select("item_id", F.make_valid_utf8("text").alias("text")).where(F.col("text").isNotNull()).toLocalIterator():
        rows.append((r.item_id, r.text))
        size += len(r.text)
        if size >= block_chars:
            yield Items(rows)
            rows, size = [], 0
    if rows:
        yield Items(rows)


SCHEMA = "doc_id long, item_id long, coverage double, tiles array<struct<item_at: int, doc_at: int, words: int>>"


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block_chars: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, coverage, tiles): every document and item pair whose coverage reaches the threshold.

    The benchmark goes out in blocks of bounded size, one pass over the documents for each, so any size of
    benchmark is exact.  Each block's rows are written to the shared folder and its broadcast is released
    before the next one, so no more than one lives at a time (a single block is left to run lazily).  Items
    shorter than SEED words match as a whole; very long and very repetitive texts keep within PAIRS pairs.
    Null and empty texts and items match nothing; a repeated row gives repeated pairs; null ids are kept;
    other columns are left out; empty tables give an empty result.
    """
    sc, kind, spark = docs.sparkSession.sparkContext, T.StructType.fromDDL(SCHEMA), docs.sparkSession
    src = docs.select("doc_id", F.make_valid_utf8("text").alias("body")).where(F.col("body").isNotNull())
    parts: list[DataFrame] = []
    shared = None
    for items in item_blocks(benchmark, block_chars):
        if shared is not None:
            parts[-1] = stored(parts[-1], "contaminated")
            shared.destroy()
        shared = sc.broadcast(items)

        def run(batches, shared=shared):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            schema = to_arrow_schema(kind)
            for b in batches:
                rows = [(d, i, c, [{"item_at": a, "doc_at": e, "words": m} for a, e, m in tiles]) for d, x in zip(b.column(0).to_pylist(), b.column(1)) for i, c, tiles in matches(x.as_py(), shared.value, threshold)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(4)], schema=schema)
            tidy()

        parts.append(src.mapInArrow(run, SCHEMA))
    out = parts[0] if parts else spark.createDataFrame([], SCHEMA)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block_chars: int = 8_000_000) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item of the benchmark; one narrow pass for each block.

    Null and empty texts stay, as do repeated rows and null ids; columns of any name pass through; empty
    tables change nothing.  Rows left after a block are written to the shared folder before the next block goes
    out (the last block is left to run lazily), so one broadcast lives at a time.
    """
    sc, shared = docs.sparkSession.sparkContext, None
    for items in item_blocks(benchmark, block_chars):
        if shared is not None:
            docs = stored(docs, "clean")
            shared.destroy()
        shared = sc.broadcast(items)

        def make(shared=shared):
            return lambda texts: [t is None or not matches(t, shared.value, threshold) for t in texts]

        docs = keep_rows(docs, make)
    return docs
