"""Spelling variants against brute force and on odd tables."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievework.llm import entry, variants

SMALL = "/root/testdata/sf0.001"


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counted(rows, slip=97, length=5, least=3) -> dict:
    n = Counter()
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for w in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= length and k >= least}


def brute(rows, **rule) -> dict:
    """Every word's deletions bring the pairs that may be near together; each pair is then compared."""
    n = counted(rows, **rule)
    by: dict = {}
    for w in n:
        for k in {w} | {w[:k] + w[k + 1 :] for k in range(len(w))}:
            by.setdefault(k, []).append(w)
    near_to: dict = {w: set() for w in n}
    for group in by.values():
        for a in group:
            near_to[a] |= {b for b in group if b not in near_to[a] and near(a, b)}
    form = {}
    for w, others in near_to.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near_to[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(df) -> dict:
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = rows_of(entry.op13_variants(spark, SMALL))
    assert got == brute(docs) and len(got) > 500 and sum(v[0] is not None for v in got.values()) > 20


@pytest.mark.parametrize("words,one_pass", [(1 << 19, 64 << 20), (100, 64 << 20), (100, 3000)])
def test_shards_and_passes(spark, monkeypatch, words, one_pass):
    """Letters of few kinds, so that words crowd: the same result in one trie, in several, and in several passes."""
    monkeypatch.setattr(variants, "SHARD_WORDS", words)
    monkeypatch.setattr(variants, "PASS_BYTES", one_pass)
    rnd = random.Random(4)
    pool = ["".join(rnd.choice("abcé×") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    docs = [(k, " ".join(rnd.choice(pool) for _ in range(60))) for k in range(80)]
    got = rows_of(variants.group_variants(spark.createDataFrame(docs, "doc_id long, text string"), slip=7, least_length=3, least_count=2))
    assert got == brute(docs, slip=7, length=3, least=2)
    assert any(r[1] != r[0] and r[0] for r in got.values())  # chains of two forms


def test_odd_rows(spark):
    """Nulls, no letters, capitals outside A-Z, a very long run, repeated rows, ties, clashing columns."""
    long = "lang" * 8000
    docs = [(1, None), (2, ""), (3, "1 2 -- \U0001f600"), (None, "Écoles ecoles"), (4, f"{long} {long} {long} {long}x"), (5, "WORDS words wordz wordz wordy wordy"), (5, "WORDS words wordz wordz wordy wordy"), (6, "Écoles Écoles écoles"), (7, "wordy")]
    df = spark.createDataFrame([(i, t, 1, "f", "r", 2) for i, t in docs], "doc_id long, text string, n long, form string, root string, word long")
    got = rows_of(variants.group_variants(df))
    assert got == brute(docs) and long in got and "Écoles" in got
    assert rows_of(variants.group_variants(df.where("doc_id < 4"))) == {}
    assert rows_of(variants.group_variants(df.limit(0))) == {}
    assert rows_of(variants.group_variants(df.where(F.col("doc_id").isNull()), least_count=1)) == brute([(None, "Écoles ecoles")], least=1)


def test_trie_on_odd_words():
    words = sorted([b"a", b"ab", b"abc", b"abd", b"b", b"\xe9", b"\xff\xff"])
    trie = variants.Trie.unpack(variants.Trie.pack(words, [1] * len(words)))
    for w in [*words, b"", b"zz", b"abcd", b"\xff"]:
        assert {words[k] for k in trie.near(w)} == {x for x in words if near(x.decode("latin-1"), w.decode("latin-1"))}
    none = variants.Trie.unpack(variants.Trie.pack([], []))
    assert none.near(b"a") == set()
