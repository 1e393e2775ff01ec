"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut into words (a run of spaces and what follows it up to the next space); no piece of a
supported vocabulary crosses such a cut, so the words are independent.  The distinct words of a block
of documents lie in one flat symbol array.  In each round every word finds the best rank among its
neighbouring pairs (segmented minimum) and merges that pair from the left; the array is compacted and
finished words leave it.  A word merges all non-overlapping places of its best pair in the round unless
a merge creates a pair that is at least as good, which the sequential order would take first: then
only the places up to that one are merged, so the outcome equals the one-merge-at-a-time order.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import add_columns

SPACE = "▁"
NONE = np.iinfo(np.int32).max


class BpeModel:
    """The tables of a sentencepiece BPE model with byte fallback and the identity normaliser."""

    def __init__(self, path: str):
        import sentencepiece as sp

        m = sp.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.bos, self.eos, self.unk = m.bos_id(), m.eos_id(), m.unk_id()
        pieces = [m.id_to_piece(i) for i in range(n)]
        special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) or (p[:2] == SPACE * 2 and p.strip(SPACE)) for p in self.ids):
            raise ValueError("a piece crosses a word boundary; this vocabulary is not supported")
        probe = sp.SentencePieceNormalizer(model_file=path).normalize(" AÅ  ﬁ　\n")
        if probe != (SPACE * 2 + "AÅ" + SPACE * 2 + "ﬁ　\n"):
            raise ValueError("only the identity normaliser with a dummy prefix is supported")
        byte_of = {int(p[3:5], 16): i for i, p in enumerate(pieces) if m.is_byte(i)}
        self.byte_ids = np.array([byte_of[b] for b in range(256)], np.int32)
        score = np.array([m.get_score(i) for i in range(n)])
        order = sorted(self.ids.values(), key=lambda i: -score[i])
        rank = np.full(n, NONE, np.int32)
        r = -1
        for k, i in enumerate(order):
            r = r + 1 if k == 0 or score[i] != score[order[k - 1]] else r
            rank[i] = r
        # every split of a piece in two symbols that are pieces, as a sorted table of pair keys
        keys, into = [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    into.append(i)
        # single characters that are no piece are symbols too, but no piece holds them
        o = np.argsort(np.array(keys, np.int64))
        self.n = n
        self.pair_rank, self.pair_into = rank[np.array(into)[o]], np.array(into, np.int32)[o]
        self._hash(np.array(keys, np.int64)[o])
        surface = [b"" if m.is_control(i) else bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        surface[self.unk] = " ⁇ ".encode()
        self.surface = surface

    def _hash(self, keys: np.ndarray) -> None:
        """Open addressing in numpy: a slot table that answers most look-ups with one probe."""
        bits = int(np.ceil(np.log2(len(keys) * 4)))
        self.bits, self.slot_key, self.slot_row = bits, np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        at, left, probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            s = (at[left] + probes) & ((1 << bits) - 1)
            free = self.slot_key[s] == -1
            _, first = np.unique(s, return_index=True)
            take = np.zeros(len(left), bool)
            take[first] = True
            take &= free
            self.slot_key[s[take]], self.slot_row[s[take]] = keys[left[take]], left[take]
            left, probes = left[~take], probes + 1
        self.probes = probes

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of neighbouring symbols; NONE where there is no such piece."""
        keys = a.astype(np.int64) * self.n + b
        keys[(a < 0) | (b < 0)] = -2
        rank, into = np.full(len(keys), NONE, np.int32), np.full(len(keys), -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        for p in range(self.probes):
            s = (at[left] + p) & ((1 << self.bits) - 1)
            found = self.slot_key[s]
            hit = found == keys[left]
            rows = self.slot_row[s[hit]]
            rank[left[hit]], into[left[hit]] = self.pair_rank[rows], self.pair_into[rows]
            left = left[~hit & (found != -1)]
            if not len(left):
                break
        return rank, into


@lru_cache(maxsize=4)
def load(path: str) -> BpeModel:
    return BpeModel(path)


def merge_words(model: BpeModel, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and the offsets (one more than words) where each begins."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    chars = "".join(words)
    cp = np.frombuffer(chars.encode("utf-32-le"), np.uint32)
    kinds, inverse = np.unique(cp, return_inverse=True)
    table = np.array([model.ids.get(chr(c), -1 - int(c)) for c in kinds], np.int64)
    sym = table[inverse]
    word = np.repeat(np.arange(len(words)), lens)
    done_sym, done_word = [], []
    left = np.arange(len(sym) - 1)
    rank, into = model.pairs(sym[:-1], sym[1:]) if len(sym) > 1 else (np.zeros(0, np.int32), np.zeros(0, np.int32))
    rank = rank.copy()
    rank[word[:-1] != word[1:]] = NONE
    rank, into = np.append(rank, NONE), np.append(into, -1)  # of the pair that begins at each symbol
    while len(sym):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(sym)))
        alive = best < NONE
        if not alive.all():
            keep = np.repeat(alive, sizes)
            done_sym.append(sym[~keep])
            done_word.append(word[~keep])
            sym, word, rank, into = sym[keep], word[keep], rank[keep], into[keep]
            if not len(sym):
                break
            best, sizes = best[alive], sizes[alive]
            starts = np.cumsum(sizes) - sizes
        here = np.flatnonzero(rank == np.repeat(best, sizes))
        # of overlapping places (a run of neighbours) every second one, from the left
        run = np.flatnonzero(np.append(True, np.diff(here) != 1))
        order = np.arange(len(here)) - np.repeat(run, np.diff(np.append(run, len(here))))
        here = here[order % 2 == 0]
        w = word[here]
        several = np.flatnonzero(np.append(w[1:] == w[:-1], False) | np.append(False, w[1:] == w[:-1]))
        if len(several):
            # a new pair at least as good as the one merged would come before the places further right
            h = here[several]
            lo, hi = np.maximum(h - 1, 0), np.minimum(h + 2, len(sym) - 1)
            before, _ = model.pairs(sym[lo], into[h])
            after, _ = model.pairs(into[h], sym[hi])
            bad = ((before <= rank[h]) & (h > 0) & (word[lo] == word[h])) | ((after <= rank[h]) & (h + 2 < len(sym)) & (word[hi] == word[h]))
            flag = np.zeros(len(here), bool)
            flag[several] = bad
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            seen = np.cumsum(flag) - flag  # bad places before this one
            here = here[seen == np.repeat(seen[first], np.diff(np.append(first, len(here))))]
        sym[here] = into[here]
        keep = np.ones(len(sym), bool)
        keep[here + 1] = False
        moved = np.cumsum(keep) - 1
        sym, word, rank, into = sym[keep], word[keep], rank[keep], into[keep]
        at = moved[here]
        again = np.unique(np.concatenate([at, at[at > 0] - 1]))
        nxt = np.minimum(again + 1, len(sym) - 1)
        r, i = model.pairs(sym[again], sym[nxt])
        r[(again + 1 >= len(sym)) | (word[nxt] != word[again])] = NONE
        rank[again], into[again] = r, i
    sym, word = (np.concatenate(done_sym), np.concatenate(done_word)) if done_sym else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    o = np.argsort(word, kind="stable")
    return _with_bytes(model, sym[o], word[o], len(words))


def _with_bytes(model: BpeModel, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters outside the vocabulary become their UTF-8 byte pieces."""
    out = np.flatnonzero(sym < 0)
    if len(out):
        kinds, inverse = np.unique(sym[out], return_inverse=True)
        coded = [model.byte_ids[list(chr(-1 - int(c)).encode())] for c in kinds]
        size = np.ones(len(sym), np.int64)
        size[out] = np.array([len(c) for c in coded])[inverse]
        begin = np.cumsum(size) - size
        flat = np.repeat(sym, size)
        pad = np.zeros((len(kinds), 4), np.int64)
        for k, c in enumerate(coded):
            pad[k, : len(c)] = c
        for j in range(4):
            some = size[out] > j
            flat[begin[out][some] + j] = pad[inverse[some], j]
        sym, word = flat, np.repeat(word, size)
    counts = np.bincount(word, minlength=n) if len(word) else np.zeros(n, np.int64)
    return sym.astype(np.int32), np.append(0, np.cumsum(counts))


def split_words(text: str) -> list[str]:
    """Words of the text, each with the spaces before it but the one that marked() adds.

    Spaces at the end form a word of their own.  A literal space mark is the same symbol as a space.
    """
    if not text:
        return []
    parts = text.replace(SPACE, " ").split(" ")
    if "" not in parts:
        return parts  # the leading space mark is implied
    words, gap = [], ""
    for p in parts:
        if p:
            words.append(gap + p)
            gap = ""
        else:
            gap += " "
    if gap:
        words.append(gap)
    return words


def marked(word: str) -> str:
    """The symbols of a word of split_words(): a word of spaces alone already has its full number."""
    return (SPACE + word if word.strip(" ") else word).replace(" ", SPACE)


def encode_block(model: BpeModel, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text with begin and end ids."""
    known: dict[str, int] = {}
    put = known.setdefault
    lists = [[put(w, len(known)) for w in split_words(t)] for t in texts]
    ids, offs = merge_words(model, [marked(w) for w in known])
    size = np.diff(offs)
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((x for row in lists for x in row), np.int64, int(counts.sum()))
    n = size[flat]
    ends = np.cumsum(n)
    where = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(offs[flat], n)
    every = ids[where] if len(where) else np.zeros(0, np.int32)
    cuts = np.append(0, ends)[np.append(0, np.cumsum(counts))]
    return [np.concatenate([[model.bos], every[a:b], [model.eos]]).astype("<u4") for a, b in zip(cuts[:-1], cuts[1:])]


def decode(model: BpeModel, ids: np.ndarray) -> str:
    """Text of the ids: control ids vanish, the first space mark goes, broken bytes turn to U+FFFD."""
    s = model.surface
    body = ids.tolist()
    raw = b"".join([s[i] for i in body])
    if raw[:1] == b" ":
        raw = raw[1:]
    return raw.decode("utf-8", errors="replace")


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 1_000_000) -> DataFrame:
    """(id, ids array<int>, decoded string): every whole text encoded, then decoded again from its ids.

    A null text counts as empty; rows keep their number, repeated rows and null ids included; an empty
    table gives an empty result; other columns are left out (id_col must not be called ids or decoded).  No shuffle; memory is bounded by
    block_chars bytes (or one text).
    """

    def make():
        model = load(model_path)

        def run(texts):
            coded = encode_block(model, texts)
            return [[c.astype(np.int32) for c in coded], [decode(model, c) for c in coded]]

        return run

    return add_columns(docs, [id_col], "ids array<int>, decoded string", make, text_col, block_bytes=block_chars)


def digest_documents(docs: DataFrame, model_path: str, block_chars: int = 1_000_000) -> DataFrame:
    """The digests of encode_documents' output, taken in the same pass so that no id array leaves the worker.

    Null and empty texts have the begin and end ids alone; very long ones are a block of their own; repeated
    rows and null ids stay, extra columns are left out, an empty table gives an empty result.
    """

    def make():
        model = load(model_path)
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def run(texts):
            coded = encode_block(model, texts)
            return [[len(c) for c in coded], [sha(c.tobytes()) for c in coded], [sha(decode(model, c).encode()) for c in coded]]

        return run

    return add_columns(docs, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", make, block_bytes=block_chars)


def encode_rows(docs: DataFrame, model_path: str, block_chars: int = 1_000_000) -> DataFrame:
    """(doc_id, n_tokens, ids, exact): the ids of every whole text, and whether their decoding equals it.

    Odd rows as in digest_documents().
    """

    def make():
        model = load(model_path)

        def run(texts):
            coded = encode_block(model, texts)
            return [[len(c) for c in coded], [c.astype(np.int32) for c in coded], [decode(model, c) == t for c, t in zip(coded, texts)]]

        return run

    return add_columns(docs, ["doc_id"], "n_tokens long, ids array<int>, exact boolean", make, block_bytes=block_chars)
