"""SimHash near-duplicates: 64-bit fingerprints and an exact tiled comparison of all distinct ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, add_columns, cut, stored
from .graph import connected_components

#: Fewest and most fingerprints in a block of the comparison grid, and the number of blocks a small table is cut into.
#: A block is at most 4 MB in a task; a larger table has more of them.
BLOCK_ROWS, MOST_ROWS, GRID = 8_192, 131_072, 48
#: keep_one() looks at pairs that differ in at most so many of the first 64 and of all 192 bits.  Sets of equal
#: size at Jaccard 0.8 differ in 10 (standard deviation 3) and 29 (5) on average, unrelated ones in 32 and 96.
NEAR, NEAR_ALL = 25, 58
#: keep_one() compares the fingerprints of sets that have some of their smallest shingle hashes in common: at most KEYS of
#: each set are looked at, so many that two sets at the threshold share too few of them with a chance of 2 * MISS at most.
KEYS, MISS = 32, 1e-11
#: Sets with one key that meet in a task, and rows of keys that a task takes at once, or so.
PART, TOGETHER = 2048, 16_384


def _majority(h: np.ndarray) -> np.ndarray:
    """The bits that over half of the rows of 64-bit numbers (rows x words) have."""
    ones = np.zeros(64 * h.shape[1], np.int64)
    for k in range(0, len(h), 4096):
        part = np.ascontiguousarray(h[k : k + 4096])
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")


def shingles(text: bytes, size: int) -> list[bytes]:
    """Space-joined runs of `size` words, repeats included; the whole sequence if there are fewer."""
    words = text.lower().split()  # bytes: A-Z only, and cuts at 0x20 and 0x09-0x0D
    joined = b" ".join(words)
    if len(words) <= size:
        return [joined] if words else []
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 1) - 1
    return [joined[a:b] for a, b in zip((ends - n)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority of the XXH64 (seed 42) bits of the word shingles; no words: zero."""
    import xxhash

    hash_of = xxhash.xxh64_intdigest
    h = np.array([hash_of(x, 42) for x in shingles(text, shingle)], np.uint64)
    return int(_majority(h[:, None])[0]) if len(h) else 0


def wide_fingerprint(parts: list[bytes]) -> tuple[int, bytes, np.ndarray]:
    """The majority of 64 and of 128 more bits of the shingles, and the 64 bits of each."""
    import xxhash

    if not parts:
        return 0, bytes(16), np.zeros(0, np.uint64)
    one, two = xxhash.xxh64_intdigest, xxhash.xxh3_128_digest
    h = np.column_stack([np.array([one(x, 42) for x in parts], np.uint64), np.frombuffer(b"".join([two(x, 42) for x in parts]), np.uint64).reshape(-1, 2)])
    got = _majority(h)
    return int(got[0]), got[1:].tobytes(), h[:, 0]


def smallest(h: np.ndarray, matches: int, percent: int) -> np.ndarray:
    """Of the hashes of a set so many of the smallest that it has `matches` in common with any set similar enough; KEYS at most.

    A set of n shingles shares percent / 100 * n at least with any similar one, and all its others may come before the first
    `matches` of these.  Of a set of so few shingles that it cannot share `matches`, all are taken.  For sets that KEYS
    cuts short, the chance of fewer common ones is that of fewer than `matches` successes among KEYS draws (least_matches).
    """
    n = len(h)
    take = min(KEYS, n, n - -(-percent * n // 100) + matches)
    return np.partition(h, take)[:take] if take < n else h


def add_fingerprint(docs: DataFrame, shingle: int = 4, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) and the fingerprint of `text`: fp, a signed long.

    A null text has no words.  Kept columns pass through unchanged; no shuffle.
    """
    keep = docs.columns if keep is None else keep
    make = lambda: lambda texts: [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]
    return add_columns(docs, keep, "fp long", make, binary=True)


def add_set_fingerprint(docs: DataFrame, shingle: int, keep: list[str], matches: int, percent: int) -> DataFrame:
    """The columns `keep` and, of the set of distinct shingles: fp, 16 bytes more of the fingerprint (more), n, a digest (sid), keys (smallest())."""

    def make():
        import xxhash

        def run(texts):
            sets = [sorted(set(shingles(t, shingle))) for t in texts]
            got = [wide_fingerprint(s) for s in sets]
            keys = [smallest(g[2], matches, percent).view(np.int64) for g in got]
            return [np.array([g[0] for g in got], np.uint64).view(np.int64), [g[1] for g in got], [len(s) for s in sets], [xxhash.xxh3_128_digest(b"\n".join(s)) for s in sets], keys]

        return run

    return add_columns(docs, keep, "fp long, more binary, n long, sid binary, keys array<long>", make, binary=True)


def components(fps: DataFrame, radius: int = 4, block_rows: int = BLOCK_ROWS, grid: int = GRID) -> DataFrame:
    """(fp, root): the class of every distinct fingerprint of `fps` (a column fp), linked at `radius` or fewer bits.

    Each pair of blocks sends back a spanning forest of its links, so a dense group gives no more rows than it has
    members.
    """
    distinct = cut(fps.select("fp").distinct())

    def links(a: np.ndarray, b: np.ndarray | None) -> pd.DataFrame:
        return pd.DataFrame(forest(a, b, radius), columns=["u", "v"])

    edges = compared(distinct, ["fp"], radius, links, "u long, v long", block_rows, grid)
    if edges is None:
        return distinct.select("fp", F.col("fp").alias("root"))
    return distinct.join(connected_components(edges).withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def compared(distinct: DataFrame, columns: list[str], radius: int, work: Callable[[np.ndarray, np.ndarray | None], pd.DataFrame], schema: str, block_rows: int = BLOCK_ROWS, grid: int = GRID) -> DataFrame | None:
    """What `work` gives for every pair of blocks of the rows of `distinct`, and for every block alone; None if there are no rows.

    `columns` are longs; the first is the fingerprint, the last tells rows apart.  Every pair of rows is in a block or a
    pair of blocks, but for blocks whose population counts alone prove a distance over the radius.  The rows, sorted by
    population count, are cut into blocks of at most MOST_ROWS; a block pair is one group of two packed blocks,
    and a larger table has more of them.  Blocks whose population counts are near have neighbouring numbers, so a
    block's partners are a range of numbers, which the executors enumerate.
    """
    spark = distinct.sparkSession
    counts = {r.pc: r.n for r in distinct.groupBy(F.bit_count(columns[0]).cast("int").alias("pc")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 65 rows
    if not counts:
        return None
    plan, pairs = _block_plan(counts, radius, min(max(block_rows, -(-sum(counts.values()) // grid)), max(block_rows, MOST_ROWS)))
    small = spark.createDataFrame(plan, "pc int, first long, parts long, begin long, last long")  # at most 65 rows
    placed = distinct.select(*columns).withColumn("pc", F.bit_count(columns[0]).cast("int")).join(F.broadcast(small), "pc").withColumn("block", F.col("first") + F.pmod(F.xxhash64(columns[-1]), F.col("parts")))

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "begin": [key[1]], "last": [key[2]], "fps": [pdf[columns].to_numpy(np.int64).tobytes()]})

    # a block travels as one binary row to each of its pairs
    packed = placed.select("block", "begin", "last", *columns).groupBy("block", "begin", "last").applyInPandas(pack, "block long, begin long, last long, fps binary")
    here = F.col("block")
    ahead = F.transform(F.sequence(here, "last"), lambda j: F.struct(here.alias("i"), j.alias("j"), F.lit(False).alias("other")))
    behind = F.when(F.col("begin") < here, F.transform(F.sequence("begin", here - 1), lambda i: F.struct(i.alias("i"), here.alias("j"), F.lit(True).alias("other"))))
    sent = packed.select("fps", F.explode(F.concat(ahead, F.coalesce(behind, F.array().cast("array<struct<i: bigint, j: bigint, other: boolean>>")))).alias("pair")).select("fps", "pair.*")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        side = {bool(o): np.frombuffer(x, np.int64).reshape(-1, len(columns)) for o, x in zip(pdf["other"], pdf["fps"])}
        return work(side[False], side.get(True))

    return sent.repartition(min(max(1, pairs), 100_000), "i", "j").groupBy("i", "j").applyInPandas(compare, schema)


def _block_plan(counts: dict[int, int], radius: int, size: int) -> tuple[list[tuple], int]:
    """(pc, first, parts, begin, last) for each population count, and the number of block pairs.

    Rows of a population count lie in `parts` blocks from number `first`; small counts next to each other
    share a block.  Blocks from `begin` to `last` may hold a fingerprint within the radius.
    """
    spans: list[list] = []  # first block, blocks, least and greatest population count, rows
    at: dict[int, int] = {}
    for pc in sorted(counts):
        if spans and spans[-1][1] == 1 and spans[-1][4] + counts[pc] <= size:
            spans[-1][3:] = [pc, spans[-1][4] + counts[pc]]
        else:
            start = spans[-1][0] + spans[-1][1] if spans else 0
            spans.append([start, -(-counts[pc] // size), pc, pc, counts[pc]])
        at[pc] = len(spans) - 1
    begin = [min(t[0] for t in spans if s[2] - t[3] <= radius) for s in spans]
    last = [max(t[0] + t[1] - 1 for t in spans if t[2] - s[3] <= radius) for s in spans]
    pairs = sum((e - s[0] + 1) * s[1] - s[1] * (s[1] - 1) // 2 for s, e in zip(spans, last))
    return [(pc, spans[k][0], spans[k][1], begin[k], last[k]) for pc, k in at.items()], pairs


def forest(a: np.ndarray, b: np.ndarray | None, radius: int, total_radius: int | None = None, tile: int = 128, wide: int = 4096) -> np.ndarray:
    """A spanning forest of the links among `a` (b None) or between `a` and `b`, as (member, root) pairs.

    Rows are fingerprints, the first word the one that the radius holds for, and the last one names the row:
    a row of one word names itself, one of more has a last word that is no part of the fingerprint.
    """
    a = _ordered(a)
    b = a if b is None else _ordered(b)
    same = b is a
    box_a, box_b = _boxes(a[:, 0], tile), _boxes(b[:, 0], tile)
    parent = np.arange(len(a) + (0 if same else len(b)))
    base = 0 if same else len(a)
    wa, wb = a.view(np.uint64), b.view(np.uint64)
    ua, ub = np.ascontiguousarray(wa[:, 0]), np.ascontiguousarray(wb[:, 0])
    for i in range(0, len(a), tile):
        lo, hi = box_a[0][i // tile], box_a[1][i // tile]
        gap = np.maximum(np.maximum(lo - box_b[1], box_b[0] - hi), 0).sum(axis=1)
        near = gap <= radius
        if same:
            near[: i // tile] = False
        if not near.any():
            continue
        cols = (np.flatnonzero(near)[:, None] * tile + np.arange(tile)).ravel()
        cols = cols[cols < len(b)]
        for k in range(0, len(cols), wide):
            c = cols[k : k + wide]
            x, y = np.nonzero(np.bitwise_count(ua[i : i + tile, None] ^ ub[None, c]) <= radius)
            x, y = x + i, c[y]
            if same:
                x, y = x[x < y], y[x < y]
            if total_radius is not None and len(x):
                on = np.bitwise_count(wa[x, :-1] ^ wb[y, :-1]).sum(axis=1) <= total_radius
                x, y = x[on], y[on]
            if len(x):
                _unite(parent, x, y + base)
    root = _roots(parent)
    every = a[:, -1] if same else np.concatenate([a[:, -1], b[:, -1]])
    moved = np.flatnonzero(root != np.arange(len(root)))
    return np.stack([every[moved], every[root[moved]]], axis=1)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Sorted by the population counts of the four 16-bit quarters of the first word, so that tiles have narrow ranges."""
    q = _quarters(x[:, 0])
    return np.ascontiguousarray(x[np.lexsort((q[:, 3], q[:, 2], q[:, 1], q[:, 0]))])


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(x).view(np.uint16).reshape(-1, 4)).astype(np.int64)


def _boxes(x: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest population count of each quarter in each tile; their gaps bound the distance from below."""
    q = _quarters(x)
    at = np.arange(0, len(x), tile)
    return np.minimum.reduceat(q, at), np.maximum.reduceat(q, at)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _unite(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins x[i] and y[i] for all i, by lowering roots until all links agree."""
    while True:
        parent[:] = _roots(parent)
        rx, ry = parent[x], parent[y]
        differ = rx != ry
        if not differ.any():
            return
        x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
        np.minimum.at(parent, np.maximum(rx, ry), np.minimum(rx, ry))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): the class of every row, named by its smallest doc_id.

    Rows whose fingerprints differ in at most `radius` bits are linked; classes are the connected parts.
    Copies meet in one fingerprint before any comparison.  Null and empty texts have fingerprint zero and
    are linked like others; a null doc_id is kept and names no class unless the class has no other id;
    repeated rows stay repeated; extra columns are left out; an empty table gives an empty result.
    """
    fps = cut(add_fingerprint(docs, shingle, ["doc_id"]))
    return with_component(fps, fps, components(fps, radius), "fp").select("doc_id", "fp", "component_id")


def with_component(rows: DataFrame, fps: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """`rows` with root and component_id; rows need `key`, fps are all the pairs (doc_id, key), classes (key, root)."""
    least = fps.groupBy(key).agg(F.min("doc_id").alias("least"))
    named = least.join(classes, key)
    name = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = cut(named.join(name, "root").select(key, "root", "component_id"))
    return rows.join(by_key, key)


def stars(live: DataFrame, percent: int) -> DataFrame:
    """(node, pivot): of the least sets of its keys the least one that is near to a set in fingerprint and like it in size.

    Each row of a key meets one other, so the rows grow with the sets, whatever the size of a key.
    """
    flat = live.select("node", "n", "fp", "m1", "m2", F.explode("toks.token").alias("token"))
    pivot = flat.groupBy("token").agg(F.min(F.struct("node", "n", "fp", "m1", "m2")).alias("p"), F.count(F.lit(1)).alias("m")).where("m > 1").select("token", "p")
    first, *more = [F.bit_count(F.col(c).bitwiseXOR(F.col(f"p.{c}"))) for c in ("fp", "m1", "m2")]
    alike = 100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")
    met = flat.join(pivot, "token").where((F.col("p.node") < F.col("node")) & alike & (first <= NEAR) & (first + more[0] + more[1] <= NEAR_ALL))
    return met.groupBy("node").agg(F.min("p.node").alias("pivot"))


def _common(group: np.ndarray, lists: pd.Series) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that says of the rows x and y, which lie in one group each, whether their lists have an element in common.

    Elements that come twice or more in a group are its bits, the most frequent first; rows are sorted by group.
    """
    owner = np.repeat(np.arange(len(lists)), [len(e) for e in lists])
    element = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
    order = np.lexsort((element, group[owner]))
    owner, element = owner[order], element[order]
    first = np.flatnonzero(np.append(True, (group[owner][1:] != group[owner][:-1]) | (element[1:] != element[:-1]))[: len(owner)])
    count = np.diff(np.append(first, len(owner)))
    kind = np.repeat(np.arange(len(first)), count)  # of each element: the group's
    home = group[owner[first]]
    rank = np.zeros(len(first), np.int64)
    by_count = np.lexsort((-count, home))
    rank[by_count] = np.arange(len(first)) - np.searchsorted(home, home)
    twice = count > 1
    width = np.zeros(group[-1] + 1 if len(group) else 0, np.int64)  # words of a group's rows
    np.maximum.at(width, home[twice], rank[twice] // 64 + 1)
    wide = width[group]
    base = np.cumsum(wide) - wide
    bits = np.zeros(wide.sum(), np.uint64)
    on = twice[kind]
    np.bitwise_or.at(bits, base[owner[on]] + rank[kind[on]] // 64, np.uint64(1) << (rank[kind[on]] % 64).astype(np.uint64))

    def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        left, k = np.flatnonzero(wide[x] > 0), 0
        while len(left):
            got = (bits[base[x[left]] + k] & bits[base[y[left]] + k]) != 0
            out[left[got]] = True
            k += 1
            left = left[~got & (wide[x[left]] > k)]
        return out

    return common


def near_pairs(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The pairs that keep_one() settles in its second round, as rows of settle.PAIRS.

    Rows with equal token, i and j are the sets of a key, or two parts of them.  A pair is taken if it is near in the first
    word and in all three, its sizes allow the similarity, its nodes are not of one class already, and neither of its
    sets' earlier keys is common to both.  Rows at each distance in turn are compared, in all keys at once; as the sets of
    a key rise in size, those that differ too much from the next ones are left out of all further ones.
    """
    pdf = pdf.sort_values(["token", "i", "j", "n"], kind="stable")
    node, root, n, part = (pdf[c].to_numpy(np.int64) for c in ("node", "root", "n", "part"))
    words = [pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("fp", "m1", "m2")]
    key = pdf[["token", "i", "j"]].to_numpy(np.int64)
    fresh = np.ones(len(pdf), bool)
    fresh[1:] = (key[1:] != key[:-1]).any(axis=1)
    end = np.append(np.flatnonzero(fresh)[1:], len(pdf))[np.cumsum(fresh) - 1]  # of each row's key
    across = key[:, 1] != key[:, 2]  # two parts: only pairs between them
    met_before = _common(np.cumsum(fresh) - 1, pdf["earlier"])
    pairs: list[np.ndarray] = []
    left = np.arange(len(pdf))
    for d in range(1, len(pdf)):
        left = left[left + d < end[left]]
        left = left[100 * n[left] >= percent * n[left + d]]
        if not len(left):
            break
        x, y = left, left + d
        on = (np.bitwise_count(words[0][x] ^ words[0][y]) <= NEAR) & (root[x] != root[y]) & (~across[x] | (part[x] != part[y]))
        x, y = x[on], y[on]
        on = sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int64) for w in words) <= NEAR_ALL
        x, y = x[on], y[on]
        on = ~met_before(x, y)
        if on.any():
            pairs.append(np.stack([x[on], y[on]]))
    if not pairs:
        return pd.DataFrame(columns=["node", "partners", "tree"])
    x, y = np.concatenate(pairs, axis=1)
    names, at = np.unique(node, return_inverse=True)
    parent = np.arange(len(names))
    _unite(parent, at[x], at[y])
    moved = np.flatnonzero(parent != np.arange(len(names)))
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    begin = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    out = pd.DataFrame({"node": np.append(node[x[begin]], names[moved]), "tree": np.arange(len(begin) + len(moved)) >= len(begin)})
    out["partners"] = [*np.split(node[y], begin[1:]), *names[parent[moved]][:, None]]
    return out[["node", "partners", "tree"]]


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row, all columns, of every class of near-duplicates: the one with the smallest doc_id.

    Two texts are linked if the Jaccard similarity of their sets of word shingles is `similarity` or more.
    Fingerprints of the distinct sets only propose pairs (NEAR and NEAR_ALL, made for 0.8 and above); each pair is
    settled by its texts, in cells of bounded size (settle.py), before any class is formed, so that chance proposals
    join nothing.  Fingerprints are compared where sets have keys in common, their smallest shingle hashes: similar sets share
    `matches` of them at least (smallest()), so sets with fewer that any other has are left out, and pairs are looked for
    among all but the matches - 1 most frequent of the others' keys.  First every set is held against one set near it in
    fingerprint, which joins groups of near-copies; then all proposed pairs whose sets are not in one class yet are settled.
    Sets of so few shingles that only an equal set can be similar enough are not compared at all.

    Null ids come last, and of rows with one id in one class that with the smaller text hash stays.  Texts are
    shuffled to meet the keys of proposed members and of those that stay.  Texts without words have the empty set
    and are one class; of equal ids the tie goes to the smaller text hash; very long texts are whole; an
    empty table gives an empty result; columns of any other name pass through.
    """
    from .minhash import least_matches, meeting, shared_postings, size_class
    from .settle import PAIRS, Texts, cells, pair_links, placed, star_links

    percent, matches = round(100 * similarity), least_matches(KEYS, similarity, MISS)
    i, th = F.coalesce(F.col("doc_id"), F.lit(NULL_ID)), F.xxhash64(F.lit("row"), "text")
    rows = stored(add_set_fingerprint(docs.select("doc_id", th.alias("th"), F.octet_length("text").cast("long").alias("bytes"), "text"), shingle, ["doc_id", "th", "bytes"], matches, percent), "fingerprints")
    word = lambda k: F.conv(F.hex(F.substring("more", k, 8)), 16, -10).cast("long")
    sets = rows.groupBy("sid").agg(F.min(F.struct(i.alias("i"), "th", "bytes")).alias("r"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("more").alias("more"), F.first("keys").alias("keys"))
    sets = stored(sets.select("sid", "r.*", "n", "fp", word(1).alias("m1"), word(9).alias("m2"), "keys", F.monotonically_increasing_id().alias("node")), "sets")
    fewest = -(-100 // (100 - percent)) - 1  # sets of a and a + 1 shingles are similar at best by a / (a + 1)
    some = sets.where(F.col("n") >= fewest)

    least = F.least(F.lit(matches), F.ceil(F.col("n") * percent / 100)).cast("int")  # keys in common with any similar set
    flat = some.select("node", size_class(F.col("n"), percent).alias("c"), F.explode("keys").alias("token"))
    live = stored(shared_postings(flat).join(some.select("node", "n", "fp", "m1", "m2"), "node").withColumn("least", least).where(F.size("toks") >= F.col("least")), "live")
    star = cut(live.select("node").join(stars(live, percent), "node", "left"))
    facts = placed(sets.select("node", "i", "th", "bytes").join(star, "node"))
    texts = Texts(docs, rows, facts)
    first = cut(star_links(facts, texts, shingle, percent))
    roots = connected_components(first)

    # the rarest keys, where sets of several classes meet
    state = live.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("head", F.slice("toks.token", F.lit(1), F.size("toks") - F.col("least") + 1))
    posted = cut(state.select("node", "c", "root", "head", F.posexplode("head").alias("pos", "token")).select("node", "c", "root", "token", F.slice("head", F.lit(1), F.col("pos")).alias("earlier")))
    dealt, tasks = meeting(posted, state.select("node", "n", "fp", "m1", "m2"), PART, TOGETHER)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        return near_pairs(pdf, percent)

    found = dealt.groupBy(F.pmod(F.xxhash64("token", "i", "j"), F.lit(tasks)).alias("g")).applyInPandas(pairs, PAIRS)
    links = first.unionByName(pair_links(cells(stored(found, "proposed"), facts), texts, shingle, percent))
    classes = sets.select("sid", "node").join(connected_components(links), "node", "left").select("sid", F.coalesce("root", "node").alias("root"))
    named = rows.select("doc_id", "th", "sid")
    cand = with_component(named, named, cut(classes), "sid").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    same = cand.groupBy("root", "th").agg(F.count(F.lit(1)).alias("n"), F.first("doc_id").alias("doc_id"))
    stay = cut(same.groupBy("root").agg(F.min(F.struct("th", "n", "doc_id")).alias("s")).select(F.coalesce("s.doc_id", F.lit(NULL_ID)).alias("i"), F.col("s.th").alias("th"), F.col("s.n").alias("n")))
    again = stay.where("n > 1").limit(1).count()
    whole = docs.select(i.alias("i"), th.alias("th"), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("kept"))
    out = whole.join(stay.select("i", "th"), ["i", "th"], "left_semi")
    if again:  # the very row comes more than once
        out = out.dropDuplicates(["i", "th"])
    return out.select(*[F.col("kept").getField(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
