"""Repeated byte strings across documents, found by a column-wise multi-document suffix index."""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, stored, text_slices, tidy

#: Bits of the fixed-size key filter (16 MB): keys seen twice set a bit, whatever the corpus.
FILTER_BITS = 27
#: Starts in a piece of a run, bytes of a collection, and runs of one key beyond which its runs are cut finer.
#: HOT changes how keys are cut, not what is found: finer keys are equal for equal strings too.
PIECE, COLLECTION, HOT = 128, 1_000_000, 20_000
#: Bytes of text whose snippets are collapsed before they are sent, and of neighbouring texts that are hashed at once.
SENT, BLOCK = 4_000_000, 1 << 14

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def blocks(texts, length: int):
    """(number of the first text, texts joined, their offsets, their sizes) of neighbours of about BLOCK bytes; none under `length`."""
    held: list[bytes] = []
    first = size = 0
    for k, t in enumerate(texts):
        held.append(t.as_py())
        size += len(held[-1])
        if size >= BLOCK or k + 1 == len(texts):
            n = np.array([len(x) for x in held], np.int64)
            yield first, b"".join(held), np.cumsum(n) - n, n
            held, first, size = [], k + 1, 0


def block_runs(data: np.ndarray, off: np.ndarray, size: np.ndarray, length: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, starts, key) of the runs of all texts of a block, which none crosses, as runs() gives them; and the grams' hashes."""
    w = window_of(length)
    h = gram_hash(data, length - w + 1)
    key = window_min(h, w)
    new = np.append(True, key[1:] != key[:-1])
    new[off] = True
    end = off + size - length + 1  # the starts from here to the next text reach into it
    new[end[end < len(new)]] = True
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(key)))
    own = first < end[np.searchsorted(off, first, "right") - 1]
    return *_cut(first[own], n[own], key, most), h


def run_keys(data: np.ndarray, off: np.ndarray, size: np.ndarray, length: int, most: int) -> np.ndarray:
    """The key of each run of a block; once more for a run in which the key's gram stands twice, as it may repeat itself."""
    first, n, key, h = block_runs(data, off, size, length, most)
    span = n + window_of(length) - 1
    begin = np.cumsum(span) - span
    same = h[np.repeat(first - begin, span) + np.arange(span.sum())] == np.repeat(key, span)
    return np.concatenate([key, key[np.add.reduceat(same, begin, dtype=np.int32) > 1]])


def window_of(length: int) -> int:
    """Starts in a window: the power of two at or below 0.65 of the string length."""
    return 1 << max(0, int(np.log2(max(1.0, 0.65 * length))))


def gram_hash(data: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of `size` bytes, by doubling."""
    h, n, out, have = data.astype(np.uint64) * _M[0] + np.uint64(salt * 2654435761 + 1), 1, None, 0
    left, level = size, 0
    while left:
        if left & 1:
            if out is None:
                out, have = h, n
            else:
                out = out[: max(0, len(h) - have)] * _M[(level + 3) % 8]
                out += h[have:]
                have += n
        left >>= 1
        level += 1
        if left:
            h, more = h[:-n] * _M[level % 8], h[n:]
            h += more
            h ^= h >> np.uint64(31)
            n *= 2
    out = out * _M[7]
    out ^= out >> np.uint64(29)
    return out * _M[4]


def window_min(h: np.ndarray, window: int) -> np.ndarray:
    """Least value of every `window` (a power of two) neighbours."""
    step = 1
    while step < window:
        h = np.minimum(h[:-step], h[step:]) if len(h) > step else h[:0]
        step *= 2
    return h


def runs(data: np.ndarray, length: int, most: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, key) of the maximal runs of starts with one key, cut at `most` starts.

    The key of a start is the least hash among the grams in the string of `length` bytes there, so equal
    strings have equal keys wherever they stand.
    """
    w = window_of(length)
    key = window_min(gram_hash(data, length - w + 1, salt), w)
    return _cut_runs(key, most)


def _cut_runs(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return _cut(first, np.diff(np.append(first, len(key))), key, most)


def _cut(first: np.ndarray, size: np.ndarray, key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut at `most` starts, with their keys."""
    if size.max() > most:
        pieces = -(-size // most)
        base = np.repeat(first, pieces)
        step = np.arange(len(base)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        end = np.repeat(first + size, pieces)
        first = base + step * most
        size = np.minimum(end - first, most)
    return first, size, key[first]


class Index:
    """Burrows-Wheeler transform and common prefixes of a collection, built column by column.

    Round j puts in the suffix of j bytes of every document that has so many, at the place that the
    ranks of its first byte give; the transform and the (capped) common prefixes of neighbours are read
    and written anew as whole sequential files each round.  Bytes are shifted by one, 0 ends a document.
    Where a document holds 0xFF, which UTF-8 never has, symbols take two bytes.
    """

    def __init__(self, docs: list[bytes], cap: int, folder: str):
        self.order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        self.size = np.array([len(docs[i]) for i in self.order], np.int64)
        self.cap = cap
        kind = np.uint8 if cap < 255 else np.uint16
        m, rounds = len(docs), int(self.size.max(initial=0))
        self.symbol, self.symbols = (np.uint16, 257) if any(b"\xff" in d for d in docs) else (np.uint8, 256)
        back = np.zeros((rounds + 1, m), self.symbol)  # back[j]: the byte before the suffix of j bytes
        for k, i in enumerate(self.order):
            d = np.frombuffer(docs[i], np.uint8)
            back[: len(d), k] = d[::-1].astype(self.symbol) + 1
        # opened once and overwritten in place: closing a rewritten file would send it to the disk each round
        self.bwt, self.lcp = (open(f"{folder}/{x}", "w+b", buffering=0) for x in ("bwt", "lcp"))  # noqa: SIM115
        self.kind, self.m, self.n = kind, m, m
        self._write(self.bwt, back[0])
        self._write(self.lcp, np.zeros(m, kind))
        #: places of the transform by (byte, place), and how often each byte stands there
        self.sorted, self.counts = np.argsort(back[0], kind="stable").astype(np.int32), np.bincount(back[0], minlength=self.symbols)
        # memory that all rounds share: lists of this size would be asked from the system anew each round
        most = m + int(self.size.sum())
        self.places, self.room = np.arange(most, dtype=np.int32), [np.empty(most, np.int32) for _ in range(3)]
        at = np.arange(m)  # place of each document's newest suffix, and that place's number in self.sorted
        number = np.empty(m, np.int64)
        number[self.sorted] = at
        for j in range(1, rounds + 1):
            active = int(np.searchsorted(-self.size, -j, "right"))
            at, number = self._insert(at[:active], number[:active], back[j, :active])

    def _insert(self, at: np.ndarray, number: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, lcp, order = self._read(self.bwt, self.symbol), self._read(self.lcp, self.kind), self.sorted
        n, a = len(b), len(at)
        who = np.argsort(number)  # the newest suffixes by (byte before, place)
        k, p = number[who], at[who]
        c = b[p]
        # of the k places before it by (byte, place), those that are ends or newest have no longer suffix yet
        new = k - self.counts[0] + self.m
        # common prefixes with the neighbours that begin with the same byte
        left, right = order[k - 1], order[np.minimum(k + 1, n - 1)]
        has_left, has_right = (k > 0) & (b[left] == c), (k + 1 < n) & (b[right] == c)
        ext = np.append(lcp, self.kind(0))
        up = np.where(has_left, np.minimum(1 + self._least(ext, left + 1, p + 1, has_left), self.cap), 0)
        down = np.where(has_right, np.minimum(1 + self._least(ext, p + 1, right + 1, has_right), self.cap), 0)
        keep = np.ones(n + a, bool)
        keep[new] = False
        b2, l2 = np.empty(n + a, self.symbol), np.empty(n + a, self.kind)
        b2[keep], l2[keep] = b, lcp
        # an old suffix that now follows a new one shares `down` bytes with it
        follows = new + 1
        ok = follows < n + a
        ok[ok] = keep[follows[ok]]
        l2[follows[ok]] = down[ok]
        put = before[who]
        b2[new], l2[new] = put, up
        self._write(self.bwt, b2)
        self._write(self.lcp, l2)
        self.n = n + a
        # the same for the places by (byte, place): old ones move up, new ones find theirs in their byte's part
        by = np.argsort(put, kind="stable")
        s, q = put[by], new[by]
        old = new - np.arange(a)  # how many old ones stand before each new one
        cut = np.append(np.flatnonzero(np.append(True, s[1:] != s[:-1])), a)
        part, of, small = np.append(0, np.cumsum(self.counts)).tolist(), s[cut[:-1]].tolist(), old[by].astype(np.int32)
        spot = np.empty(a, np.int64)
        for x, y, c in zip(cut[:-1].tolist(), cut[1:].tolist(), of):  # one type on both sides, or the part would be copied to another
            spot[x:y] = order[part[c] : part[c + 1]].searchsorted(small[x:y])
            spot[x:y] += part[c]
        spot += np.arange(a)
        shift = np.repeat(self.places[: a + 1], np.diff(old, prepend=0, append=n))
        shift += self.places[:n]
        moved = np.take(shift, order, out=self.room[2][:n], mode="clip")
        keep[:] = True
        keep[spot] = False
        self.room = [self.room[1], self.room[0], self.room[2]]
        self.sorted = self.room[0][: n + a]  # the old list is in the other one
        self.sorted[keep], self.sorted[spot] = moved, q
        self.counts = self.counts + np.bincount(s, minlength=self.symbols)
        at2, number2 = np.empty(a, np.int64), np.empty(a, np.int64)
        at2[who], number2[who[by]] = new, spot
        return at2, number2

    def _read(self, file, kind) -> np.ndarray:
        file.seek(0)
        return np.fromfile(file, kind, self.n)

    @staticmethod
    def _write(file, data: np.ndarray) -> None:
        file.seek(0)
        left = memoryview(np.ascontiguousarray(data)).cast("B")
        while len(left):
            left = left[file.write(left) :]

    @staticmethod
    def _least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Least of x[lo:hi] for each pair that is on."""
        out = np.zeros(len(lo), np.int64)
        w = np.flatnonzero(on)
        w = w[np.argsort(lo[w], kind="stable")]
        if len(w):
            out[w] = np.minimum.reduceat(x, np.stack([lo[w], hi[w]], axis=1).ravel())[::2]
        return out

    def repeated(self) -> list[np.ndarray]:
        """For each document, which starts have `cap` bytes in common with a neighbour in the index."""
        lcp = self._read(self.lcp, self.kind)
        self.bwt.close()
        self.lcp.close()
        flag = lcp >= self.cap
        flag[:-1] |= flag[1:]
        step = np.empty(len(flag), np.int64)
        step[self.sorted] = np.arange(len(flag))  # from a suffix to the one a byte longer
        out: list[np.ndarray] = [np.zeros(max(0, int(s) - self.cap + 1), bool) for s in self.size]
        grid = np.zeros((int(self.size.max(initial=0)) + 1, self.m), bool)
        at = np.arange(self.m)
        for j in range(1, len(grid)):
            at = step[at[: int(np.searchsorted(-self.size, -j, "right"))]]
            grid[j, : len(at)] = flag[at]
        back: list = [None] * self.m
        for k, i in enumerate(self.order):
            s = int(self.size[k])
            if s >= self.cap:
                out[k] = grid[self.cap : s + 1, k][::-1].copy()
            back[i] = out[k]
        return back


def _row_keys() -> tuple[Column, Column]:
    """Two independent 64-bit values of a row's id and text, which stand for the row in joins."""
    i = F.coalesce(F.col("doc_id"), F.lit(NULL_ID))
    return F.xxhash64(i, "text"), F.xxhash64(F.lit("second"), "text", i)


def _bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """Bits of the slots of a column's values, 2 ** FILTER_BITS in all: built in parts on the executors."""
    slot = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1
    parts = rows.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in parts:
        a = (r.bucket - 1) * 4096
        out[a : a + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _has(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = (key & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _finer(data: np.ndarray, length: int, key: int) -> list[tuple[int, int, int]]:
    """A hot run cut where the keys by two more hash functions change: (first, starts, key)."""
    a, b = (runs(data, length, PIECE, salt) for salt in (1, 2))
    cuts = np.unique(np.concatenate([a[0], b[0], [len(data) - length + 1]]))
    first = cuts[:-1]
    ka, kb = a[2][np.searchsorted(a[0], first, "right") - 1], b[2][np.searchsorted(b[0], first, "right") - 1]
    mixed = (np.uint64(key) * _M[1] + ka) * _M[2] + kb
    return list(zip(first.tolist(), np.diff(cuts).tolist(), mixed.view(np.int64).tolist()))


def decide(rows: list[tuple], length: int) -> list[tuple[int, int, bytes]]:
    """(key, snippet id, packed bits of its repeated starts) for snippets (key, id, copies, starts, bytes).

    All snippets of a key are here, each once, with the number of its copies (compared byte by byte).  The
    copies of a snippet repeat each other; whether its starts repeat in other snippets, or in itself, the
    common prefixes of the index decide.  Only a snippet that is the one of its key and has copies needs
    no index.  Starts whose hash of the whole string comes but once (so that no string can equal theirs)
    are cut off before.
    """
    out, several = [], []
    at = 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end][0] == rows[at][0]:
            end += 1
        if end - at == 1 and rows[at][2] > 1:
            out.append((rows[at][0], rows[at][1], np.packbits(np.ones(rows[at][3], bool)).tobytes()))
        else:
            several += rows[at:end]
        at = end
    if not several:
        return out
    size = np.array([len(r[4]) for r in several], np.int64)
    offset = np.cumsum(size) - size
    h = gram_hash(np.frombuffer(b"".join(r[4] for r in several), np.uint8), length, 9)
    starts = np.array([r[3] for r in several], np.int64)
    place = np.repeat(offset - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
    _, which = np.unique(h[place], return_inverse=True)
    copies = np.repeat(np.array([r[2] for r in several], np.int64), starts)
    maybe = np.bincount(which, weights=copies)[which] > 1
    # maximal runs of such starts, within each snippet
    owner = np.repeat(np.arange(len(several)), starts)
    begins = np.flatnonzero(maybe & np.append(True, ~maybe[:-1] | (owner[1:] != owner[:-1])))
    ends = np.flatnonzero(maybe & np.append(~maybe[1:] | (owner[1:] != owner[:-1]), True)) + 1
    texts: dict[bytes, int] = {}
    number, count = [], []
    for a, b in zip(begins.tolist(), ends.tolist()):
        r = several[owner[a]]
        lo = int(place[a] - offset[owner[a]])
        k = texts.setdefault(r[4][lo : lo + b - a + length - 1], len(texts))
        if k == len(count):
            count.append(0)
        count[k] += r[2]
        number.append(k)
    flags = np.zeros(len(maybe), bool)
    if texts:
        with io_folder() as folder:
            found = Index(list(texts), length, folder).repeated()
        for a, b, k in zip(begins.tolist(), ends.tolist(), number):
            flags[a:b] = True if count[k] > 1 else found[k]
    edge = np.append(0, np.cumsum(starts))
    for r, a, b in zip(several, edge[:-1], edge[1:]):
        if flags[a:b].any():
            out.append((r[0], r[1], np.packbits(flags[a:b]).tobytes()))
    return out


def io_folder() -> tempfile.TemporaryDirectory:
    """A task's own folder for the index files of one collection: scratch space that a retry makes anew, never shared."""
    return tempfile.TemporaryDirectory(prefix="sievework-index-")


def _candidates(text: bytes, off: np.ndarray, size: np.ndarray, length: int, seen: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start in the block, starts, key) of the runs whose key may come twice, hot ones cut finer."""
    data = np.frombuffer(text, np.uint8)
    first, n, key, _ = block_runs(data, off, size, length, PIECE)
    on = _has(seen, key)
    first, n, key = first[on], n[on], key[on]
    much = _has(hot, key)
    if not much.any():
        return first, n, key.view(np.int64)
    parts = [(first[~much], n[~much], key[~much].view(np.int64))]
    for k in np.flatnonzero(much).tolist():
        a, m = int(first[k]), int(n[k])
        cut = np.array(_finer(data[a : a + m + length - 1], length, int(key[k])), object)
        parts.append((cut[:, 0].astype(np.int64) + a, cut[:, 1].astype(np.int64), cut[:, 2].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def repeated_starts(docs: DataFrame, length: int = 200) -> DataFrame:
    """(r1, r2, marks): for each row with any, the starts of its strings of `length` bytes that also start elsewhere.

    r1 and r2 are _row_keys(); marks is a set of (first, starts, bits).  The texts are read three times and
    not shuffled here: once to count the keys of all runs (pre-aggregated), once to name the snippets at
    keys that come twice by a hash, and once to send the snippets, those of a few megabytes of text
    collapsed with their number of copies.  A fixed-size filter selects what is sent, always a superset
    of what is needed.  Snippets meet by key, sorted, so that copies from many tasks collapse as they
    stream in, after a comparison of their bytes; each task indexes its keys in collections of bounded size.
    """
    spark = docs.sparkSession
    r1, r2 = _row_keys()
    src = docs.select(r1.alias("r1"), r2.alias("r2"), F.col("text").cast("binary").alias("t")).where(F.octet_length("t") >= length)

    def keys(batches):
        import pyarrow as pa

        for b in batches:
            found = [np.zeros(0, np.uint64)]
            for _, t, off, size in blocks(b.column(0), length):
                found.append(run_keys(np.frombuffer(t, np.uint8), off, size, length, PIECE))
            k, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["key", "n"])
        tidy()

    twice = stored(src.select("t").mapInArrow(keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "keys")
    shared = spark.sparkContext.broadcast((_bitmap(twice, "key"), _bitmap(twice.where(F.col("n") > HOT), "key")))

    def name(batches):
        import pyarrow as pa
        import xxhash

        hash_of = xxhash.xxh3_64_intdigest
        for b in batches:
            out: list = [[np.zeros(0, np.int64)] for _ in range(6)]
            r1, r2 = (b.column(k).to_numpy() for k in (0, 1))
            for at, t, off, size in blocks(b.column(2), length):
                first, n, key = _candidates(t, off, size, length, *shared.value)
                ids = np.array([hash_of(t[a : a + m + length - 1]) for a, m in zip(first.tolist(), n.tolist())], np.uint64).view(np.int64)
                owner = np.searchsorted(off, first, "right") - 1
                for k, v in enumerate((r1[at + owner], r2[at + owner], first - off[owner], n, key, ids)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int32 if k in (2, 3) else np.int64)) for k, v in enumerate(out)], names=["r1", "r2", "first", "n", "key", "sid"])
        tidy()

    pieces = stored(src.mapInArrow(name, "r1 long, r2 long, first int, n int, key long, sid long"), "pieces")

    def send(batches):
        import pyarrow as pa
        import xxhash

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for b in batches:
            for at, rows in text_slices(b.column(0), SENT):
                seen: dict[tuple[int, bytes], int] = {}
                for _, t, off, size in blocks(b.column(0).slice(at, rows), length):
                    for a, m, k in zip(*(x.tolist() for x in _candidates(t, off, size, length, *shared.value))):
                        one = (k, t[a : a + m + length - 1])
                        seen[one] = seen.get(one, 0) + 1
                ids = [xxhash.xxh3_64_intdigest(x) for _, x in seen]
                columns = [[k for k, _ in seen], [x - (x >> 63 << 64) for x in ids], list(seen.values()), [len(x) - length + 1 for _, x in seen], [x for _, x in seen]]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=["key", "sid", "copies", "n", "snippet"])
        tidy()

    texts = src.select("t").mapInArrow(send, "key long, sid long, copies long, n int, snippet binary")
    dealt = texts.repartition("key").sortWithinPartitions("key", "sid")

    def index(batches):
        import pyarrow as pa

        def result(rows):
            got = decide(rows, length)
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary())], names=["key", "sid", "bits"])

        held: list = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(5))):
                if held and held[-1][:2] == r[:2]:  # copies of one snippet from several tasks
                    if held[-1][4] != r[4]:
                        raise ValueError("two snippets of one key with one 64-bit id")
                    held[-1] = (*r[:2], held[-1][2] + r[2], *r[3:])
                    continue
                if size >= COLLECTION and r[0] != held[-1][0]:
                    yield result(held)
                    held, size = [], 0
                held.append(r)
                size += r[3] + length
        if held:
            yield result(held)
        tidy()

    marks = dealt.mapInArrow(index, "key long, sid long, bits binary")
    back = pieces.select("r1", "r2", "first", "n", "key", "sid").join(marks, ["key", "sid"])
    return back.groupBy("r1", "r2").agg(F.collect_set(F.struct("first", "n", "bits")).alias("marks"))


def covered(n_bytes: int, marks: list, length: int) -> np.ndarray:
    """Which bytes a repeated string covers."""
    edge = np.zeros(n_bytes + 1, np.int64)
    for first, n, bits in marks:
        at = first + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=n))
        at = at[at + length <= n_bytes]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
    return np.cumsum(edge)[:n_bytes] > 0


def _with_marks(docs: DataFrame, length: int) -> DataFrame:
    """All columns, with `__marks` (null: nothing repeats)."""
    r1, r2 = _row_keys()
    return docs.withColumns({"r1": r1, "r2": r2}).join(repeated_starts(docs, length).withColumnRenamed("marks", "__marks"), ["r1", "r2"], "left").drop("r1", "r2")


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """`docs` with its columns, every byte that a repeated string of `length` bytes covers cut out of `text`.

    Equal strings count wherever they start, in the same text too; all are judged on the input.  A cut
    may split a character; the rest of it is dropped with the cut, so that texts stay valid.  A null
    text stays null; repeated rows are copies of each other like any others; columns of any other name
    pass through unchanged.
    """
    names = docs.columns
    safe = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]).alias("__rest"))
    marked = _with_marks(safe.withColumn("__rest", F.col("__rest").dropFields(f"c{names.index('text')}")), length).select("__rest", F.col("text").cast("binary").alias("t"), "__marks")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for t, m in zip(b.column(1), b.column(2)):
                t, m = t.as_py(), m.as_py()
                if t is not None and m:
                    gone = covered(len(t), [(x["first"], x["n"], x["bits"]) for x in m], length)
                    t = np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", errors="ignore").encode()
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["__rest", "t"])
        tidy()

    kinds = T.StructType([marked.schema["__rest"], T.StructField("t", T.BinaryType())])
    got = marked.mapInArrow(run, kinds)
    return got.select(*[F.col("t").cast("string").alias(c) if c == "text" else F.col("__rest").getField(f"c{k}").alias(c) for k, c in enumerate(names)])


def digest_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; a null text is empty.

    Repeated rows are copies of each other; null ids stay; other columns are left out; very long texts are
    whole; an empty table gives an empty result.  Nothing depends on an order, so there are no ties.
    """
    marked = _with_marks(docs.select("doc_id", "text"), length).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("t"), "__marks")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for t, m in zip(b.column(1), b.column(2)):
                t, m = t.as_py(), m.as_py()
                kept, removed, spans = t, 0, 0
                if m:
                    gone = covered(len(t), [(x["first"], x["n"], x["bits"]) for x in m], length)
                    kept, removed = np.frombuffer(t, np.uint8)[~gone].tobytes(), int(gone.sum())
                    spans = int((np.diff(np.append(False, gone).astype(np.int8)) == 1).sum())
                rows.append((len(t), removed, spans, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array([r[k] for r in rows], pa.int64() if k < 3 else pa.string()) for k in range(4)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        tidy()

    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
