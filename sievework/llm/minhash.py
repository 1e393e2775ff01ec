"""MinHash near-duplicates: an inverted join of signature coordinates, and confirmation on the whole shingle sets.

A distinct shingle set has a signature of K coordinates, the least of K hash functions over its shingles; sets of Jaccard
similarity s agree in a coordinate with probability s.  A set is posted under each pair of coordinate and value; sets that
share at least T postings are candidates.  T is so small that a pair at the threshold misses it once in 10^8.

Postings of one set only are dropped at once, and with them the sets left with fewer than T.  First every set is
counted against the pivots of its postings, and linked with the one it meets most often if their sets agree; groups of
near-copies fall together here.  Then, as two sets that share T of their m postings share one of the m - T + 1
rarest, only these prefixes are merged; the frequent postings are skipped and looked up in the signature.  A posting whose
sets all belong to one class already is dropped, and a pair is taken up at its first common posting only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, add_columns, cut, stored
from .graph import connected_components
from .settle import CELLS, Texts, as_cells, no_cells, pair_links, placed, star_links
from .simhash import shingles

#: Coordinates of a signature, the chance at which a pair at the threshold may be missed, and sets of a
#: posting that meet in one task.
COORDINATES, MISS, PART = 64, 1e-8, 2048
#: Rows of postings that a task merges at once, or so: small postings are many, and share a task.
TOGETHER = 16_384


def least_matches(coordinates: int, similarity: float, miss: float = MISS) -> int:
    """The largest T for which a pair of this similarity has fewer than T matches with probability `miss` at most."""
    below = 0.0
    for t in range(coordinates + 1):
        below += math.comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            return max(1, t)
    return coordinates


def _functions(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(20)
    return rnd.integers(0, 2**63, coordinates, dtype=np.uint64) * 2 + 1, rnd.integers(0, 2**63, coordinates, dtype=np.uint64)


def signature(hashes: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """The upper halves of the least values of all functions over the 64-bit hashes."""
    least = np.full(len(times), 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[k : k + 1024, None] * times + plus).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def add_signature(docs: DataFrame, shingle: int, keep: list[str], coordinates: int = COORDINATES) -> DataFrame:
    """The columns `keep`, the number of distinct shingles (n), a digest of their set (sid) and its signature (sig).

    A text without words has n = 0, and neither a digest nor a signature.
    """

    def make():
        import xxhash

        hash_of, times_plus = xxhash.xxh3_64_intdigest, _functions(coordinates)

        def run(texts):
            n, sid, sig = [], [], []
            for t in texts:
                own = set(shingles(t, shingle))
                n.append(len(own))
                if own:
                    h = np.sort(np.fromiter(map(hash_of, own), np.uint64, len(own)))
                    sid.append(xxhash.xxh3_128_digest(h.tobytes()))
                    sig.append(signature(h, *times_plus))
                else:
                    sid.append(None)
                    sig.append(None)
            return [n, sid, sig]

        return run

    return add_columns(docs, keep, "n long, sid binary, sig array<int>", make, binary=True)


def _token(c: Column, v: Column) -> Column:
    return F.shiftleft(c.cast("long"), 32).bitwiseOR(v.cast("long").bitwiseAND(F.lit(2**32 - 1)))


def size_class(n: Column, percent: int) -> Column:
    """A number from 0 to 62; sets that may be similar have equal or neighbouring ones, as one is at most 100 / percent larger."""
    return F.least(F.floor(F.log(n.cast("double")) / math.log(100 / percent * (1 + 1e-9))), F.lit(62)).cast("int")


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def _meets(f: str, mask: str) -> Column:
    """Whether a set of class c may meet a similar one in a posting of f sets whose classes are the bits of `mask`."""
    beside = _bit(F.col("c") + 1).bitwiseOR(F.when(F.col("c") > 0, _bit(F.col("c") - 1)).otherwise(0))
    return (F.col(mask).bitwiseAND(beside) != 0) | (F.col(f) > F.bit_count(mask))


def postings(sets: DataFrame, matches: int) -> DataFrame:
    """(node, c, toks) of the sets with at least `matches` postings shared by sets of a like size: (f, token), the rarest first."""
    flat = sets.select("node", "c", F.posexplode("sig").alias("k", "v")).select("node", "c", _token(F.col("k"), F.col("v")).alias("token"))
    return shared_postings(flat).where(F.size("toks") >= matches)  # COORDINATES at most


def shared_postings(flat: DataFrame) -> DataFrame:
    """(node, c, toks) of sets posted as (node, c, token): those of its postings that sets of a like size share, (f, token), the rarest first."""
    shared = flat.groupBy("token").agg(F.count(F.lit(1)).alias("f"), F.bit_or(_bit(F.col("c"))).alias("mask")).where("f > 1")
    met = flat.join(shared, "token").where(_meets("f", "mask"))
    return met.groupBy("node", "c").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("toks"))


def meeting(posted: DataFrame, facts: DataFrame, size: int, together: int) -> tuple[DataFrame, int]:
    """Rows (node, c, root, token, ...) of postings where sets of several classes meet, with their `facts` (node, ...), dealt to pairs of parts.

    A posting has parts of about `size` rows, and every pair (i, j) of parts the rows of both.  The number is that of tasks of
    about `together` rows.
    """
    mixed = cut(posted.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.bit_or(_bit(F.col("c"))).alias("mask")).where("lo <> hi").select("token", "m", "mask", F.ceil(F.col("m") / size).alias("parts")))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.struct(F.least(F.col("part"), k).alias("i"), F.greatest(F.col("part"), k).alias("j")))
    open_ = posted.join(mixed, "token").where(_meets("m", "mask")).drop("c", "m", "mask").join(facts, "node").withColumn("part", part)
    rows = mixed.agg(F.sum(F.col("m") * F.col("parts"))).first()[0] or 0
    return open_.withColumn("at", F.explode(meet)).select("*", "at.i", "at.j").drop("at", "parts"), max(1, -(-rows // together))


def _values(toks: Column) -> list[Column]:
    """The shared postings of a set in little room: which coordinates it has (a bit each), and their values in that order."""
    by = F.array_sort(F.transform(toks, lambda t: t["token"]))
    have = F.aggregate(by, F.lit(0).cast("long"), lambda s, t: s.bitwiseOR(_bit(F.shiftright(t, 32).cast("int"))))
    return [have.alias("have"), F.transform(by, lambda t: F.shiftright(F.shiftleft(t, 32), 32).cast("int")).alias("vals")]


def coordinates_of(have: pd.Series, vals: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Rows x 64 values, and which coordinates a row has, of _values(): others than the shared ones agree with none."""
    on = np.unpackbits(have.to_numpy(np.int64).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    value = np.zeros(on.shape, np.int32)
    value[on] = np.concatenate([np.asarray(v, np.int32) for v in vals])
    return value, on


def stars(live: DataFrame, matches: int) -> DataFrame:
    """(node, pivot): of the least sets of its postings the one that a set meets most often, if half of `matches` times."""
    flat = live.select("node", F.explode("toks.token").alias("token"))
    pivot = flat.groupBy("token").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("m")).where("m > 1").select("token", "pivot")
    met = flat.join(pivot, "token").where("node <> pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= matches // 2)
    return met.groupBy("node").agg(F.max(F.struct("k", (-F.col("pivot")).alias("p"))).alias("b")).select("node", (-F.col("b.p")).alias("pivot"))


def candidates(pdf: pd.DataFrame, matches: int, percent: int, most: int = 32_768) -> pd.DataFrame:
    """Pairs of the postings in `pdf`, as rows (xp, xs, yp, ys, node, partners) for the cells of their blocks.

    Rows with equal token, i and j are a posting, or two parts of one.  A pair is taken if at least `matches`
    coordinates agree, the sets are not of one class, their sizes allow the similarity, and no earlier posting of
    both prefixes is common.  Rows without partners name the other nodes of a cell.  Rows at each distance in turn
    are compared, in all postings at once.
    """
    pdf = pdf.sort_values(["token", "i", "j", "root"], kind="stable")
    node, root, n, part = (pdf[c].to_numpy(np.int64) for c in ("node", "root", "n", "part"))
    before = pdf["before"].to_numpy(np.int64).view(np.uint64)
    key = pdf[["token", "i", "j"]].to_numpy(np.int64)
    value, have = coordinates_of(pdf["have"], pdf["vals"])
    fresh = np.ones(len(pdf), bool)
    fresh[1:] = (key[1:] != key[:-1]).any(axis=1)
    end = np.append(np.flatnonzero(fresh)[1:], len(pdf))[np.cumsum(fresh) - 1]  # of each row's posting
    across = key[:, 1] != key[:, 2]  # two parts: only pairs between them
    pairs: list[np.ndarray] = []
    waiting: list[np.ndarray] = []
    size = 0

    def look() -> None:
        both = np.concatenate(waiting, axis=1)
        for k in range(0, both.shape[1], most):
            x, y = both[:, k : k + most]
            agree = np.packbits((value[x] == value[y]) & have[x] & have[y], axis=1, bitorder="little").view(np.uint64)[:, 0]
            on = (np.bitwise_count(agree) >= matches) & ((agree & before[x] & before[y]) == 0)
            pairs.append(np.stack([x[on], y[on]]))

    left = np.arange(len(pdf))
    for d in range(1, len(pdf)):
        left = left[left + d < end[left]]
        if not len(left):
            break
        x, y = left, left + d
        on = (root[x] != root[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        on &= ~across[x] | (part[x] != part[y])
        if on.any():
            waiting.append(np.stack([x[on], y[on]]))
            size += int(on.sum())
            if size > most:
                look()
                waiting, size = [], 0
    if waiting:
        look()
    if not pairs or not sum(p.shape[1] for p in pairs):
        return no_cells()
    x, y = np.concatenate(pairs, axis=1)
    return as_cells(pdf[["pivot", "sub"]].to_numpy(np.int64), node, x, y)


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the class of every row, named by its smallest doc_id.

    Two rows are linked if 100 * intersection >= percent * union of their sets of distinct word shingles (A-Z
    lower-cased; a text of fewer words than a shingle has its whole sequence as one); classes are the connected parts,
    and the row whose doc_id names its class is kept.  Equal sets meet in one before anything is compared.

    Null and empty texts, and texts without words, have an empty set, are linked with nothing and are kept; a null doc_id
    names no class unless the class has no other id, and is kept in that case; repeated rows stay repeated, all with
    one answer; very long texts are whole; extra columns of any name are left out; an empty table gives an
    empty result.
    """
    if coordinates > 64:
        raise ValueError("postings are marked in 64 bits")
    matches = least_matches(coordinates, percent / 100)
    i, th = F.coalesce(F.col("doc_id"), F.lit(NULL_ID)), F.xxhash64(F.lit("row"), "text")
    size = F.octet_length("text").cast("long")
    rows = stored(add_signature(docs.select("doc_id", th.alias("th"), size.alias("bytes"), "text"), shingle, ["doc_id", "th", "bytes"], coordinates), "signatures")
    some = rows.where("sid IS NOT NULL")
    sets = some.groupBy("sid").agg(F.min("doc_id").alias("least"), F.min(F.struct(i.alias("i"), "th", "bytes")).alias("r"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    sets = stored(sets.withColumn("node", F.monotonically_increasing_id()), "sets")

    live = stored(postings(sets.select("node", size_class(F.col("n"), percent).alias("c"), "sig"), matches), "live")
    star = cut(live.select("node").join(stars(live, matches), "node", "left"))
    facts = placed(sets.select("node", "n", "r.i", "r.th", "r.bytes").join(star, "node"))
    texts = Texts(docs, rows, facts)
    first = cut(star_links(facts, texts, shingle, percent))
    roots = connected_components(first).withColumnRenamed("root", "known")

    # the prefixes, merged where sets of several classes meet
    state = facts.select("node").join(roots, "node", "left").join(live, "node").withColumn("root", F.coalesce("known", "node"))
    head = F.slice("toks", F.lit(1), F.size("toks") - (matches - 1))
    coordinate = lambda t: F.shiftright(t["token"], 32).cast("int")
    marked = F.transform(F.col("head"), lambda t, k: F.struct(t["token"].alias("token"), F.aggregate(F.slice("head", F.lit(1), k), F.lit(0).cast("long"), lambda s, e: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), coordinate(e)))).alias("before")))
    posted = cut(state.withColumn("head", head).select("node", "c", "root", F.explode(marked).alias("t")).select("node", "c", "root", "t.token", "t.before"))
    facts = facts.join(live.select("node", *_values(F.col("toks"))), "node")
    dealt, tasks = meeting(posted, facts.select("node", "have", "vals", "n", F.col("home").alias("pivot"), "sub"), PART, TOGETHER)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return candidates(pdf, matches, percent)

    found = dealt.groupBy(F.pmod(F.xxhash64("token", "i", "j"), F.lit(tasks)).alias("g")).applyInPandas(merge, CELLS)
    second = pair_links(found, texts, shingle, percent)

    last = connected_components(first.unionByName(second))
    classes = sets.select("sid", "node", "least").join(last, "node", "left").withColumn("root", F.coalesce("root", "node"))
    name = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = cut(classes.join(name, "root").select("sid", "component_id"))
    out = rows.select("doc_id", "n", "sid").join(by_set, "sid", "left").withColumn("component_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
