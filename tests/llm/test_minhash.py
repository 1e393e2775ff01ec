"""MinHash near-duplicates against brute force over all pairs, on hot groups and on odd tables."""

import random

import pandas as pd
import pytest

from sievework.llm import entry, minhash, settle

SMALL = "/root/testdata/sf0.001"


def shingle_set(text, size=2) -> set:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    joined = [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)]
    return set(joined) if len(words) >= size else {b" ".join(words)} if words else set()


def brute(rows, size=2, percent=80) -> list:
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None] if sets[k] else [i]
        least = min((x for x in ids if x is not None), default=None)
        out.append((i, len(sets[k]), least, i == least))
    return sorted(out, key=str)


def result(df) -> list:
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def words(k: int, rnd: random.Random, kinds: int = 300) -> list[str]:
    return [f"w{rnd.randrange(kinds)}" for _ in range(k)]


def edited(base: list[str], changes: int, rnd: random.Random) -> str:
    out = list(base)
    for _ in range(changes):
        out[rnd.randrange(len(out))] = f"x{rnd.randrange(10**6)}"
    return " ".join(out)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert result(entry.op11_minhash(spark, SMALL)) == brute(docs)


@pytest.mark.parametrize("part,block", [(2048, 1 << 20), (16, 2000)])
def test_groups_around_the_threshold(spark, monkeypatch, part, block):
    """Chains and groups at similarities near 0.8, whole and with postings and blocks cut small."""
    monkeypatch.setattr(minhash, "PART", part)
    monkeypatch.setattr(settle, "BLOCK_BYTES", block)
    rnd = random.Random(7)
    texts = []
    for size in (5, 9, 20, 60):
        for _ in range(4):
            base = words(size, rnd)
            texts += [edited(base, rnd.choice([0, 0, 1, 1, 2, size // 12, size // 9]), rnd) for _ in range(12)]
    hot = words(80, rnd)
    texts += [edited(hot, rnd.randint(0, 7), rnd) for _ in range(90)]  # partly linked, partly below
    chain = words(50, rnd)
    for k in range(15):  # each near the next only
        chain = chain[3:] + words(3, rnd)
        texts.append(" ".join(chain))
    rnd.shuffle(texts)
    docs = list(enumerate(texts))
    got = result(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute(docs)
    assert len({r[2] for r in got}) < len(got) - 50


def test_odd_rows(spark):
    """Nulls, empty and very long texts, few words, capitals, repeated rows and ids, clashing columns."""
    rnd = random.Random(8)
    long = " ".join(words(30_000, rnd, 10**6))
    docs = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE  two"), (8, "É é"), (9, "é é"), (10, long), (11, long + " tail"), (10, long), (5, "other words here"), (5, "one"), (None, "one two"), (None, "all alone here"), (None, "all alone here"), (None, None), (12, "\U0001f600 mit license"), (2**60, "\U0001f600 MIT license")]
    df = spark.createDataFrame([(i, t, 1, 2, "k", 3) for i, t in docs], "doc_id long, text string, n long, node long, sid string, root int")
    got = result(minhash.near_duplicates(df))
    # a row without an id, alone in its class, stands for it
    assert got == sorted([(i, n, c, i == c) for i, n, c, _ in brute(docs)], key=str)
    assert result(minhash.near_duplicates(df.limit(0))) == []
    assert result(minhash.near_duplicates(df.where("doc_id = 2"))) == [(2, 0, 2, True)]


def test_invalid_utf8(spark):
    df = spark.sql("SELECT * FROM VALUES (1L, CAST(X'FF61206220' AS STRING)), (2L, CAST(X'FF6120622063' AS STRING)), (3L, CAST(X'FF4120422020' AS STRING)) AS t(doc_id, text)")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_least_matches():
    import math

    t = minhash.least_matches(64, 0.8)
    tail = lambda t: sum(math.comb(64, k) * 0.8**k * 0.2 ** (64 - k) for k in range(t))
    assert tail(t) <= 1e-8 < tail(t + 1) and 25 < t < 35


def test_confirm_leaves_refuted_pairs_apart():
    rows = [(1, [2, 3], b"a b c d e f g h i j"), (2, [3], b"a b c d e f g h i j k"), (3, [], b"a b c d x y z")]
    got = settle.confirm(pd.DataFrame(rows, columns=["node", "partners", "text"]), 2, 80)
    assert got.to_numpy().tolist() == [[1, 2]]
