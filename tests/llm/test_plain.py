"""op10 and the pipeline's near-duplicate stage against plain versions written from their definitions."""

import math
import random
import zlib
from collections import Counter

import pytest

from sievework.llm import entry, langid, settle, simhash

SMALL = "/root/testdata/sf0.001"


def plain_words(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_grams(word: str) -> list[int]:
    marked = "\x02" + word + "\x03"
    out = []
    for n in langid.ORDERS:
        for k in range(len(marked) - n + 1):
            h = n
            for c in marked[k : k + n]:
                h = (h * 0x100000001B3 + ord(c)) % 2**64
            out.append((h * 0x9E3779B97F4A7C15) % 2**64 >> 47)
    return out


def plain_language(words: list[str], table: dict, langs: list[str], penalty: float = 12.0):
    """The mixture of one document: sets grown one language at a time, each fitted by twelve rounds of EM."""
    n = Counter(words)
    total = sum(n.values())
    like = {}
    for w in n:
        score = [sum(table[j].get(g, table[j][None]) for g in plain_grams(w)) for j in range(len(langs))]
        like[w] = [max(s - max(score), -30.0) for s in score]
    alone = [sum(n[w] * like[w][j] for w in n) for j in range(len(langs))]
    chosen = [max(range(len(langs)), key=lambda j: (alone[j], -j))]
    share = {chosen[0]: 1.0}
    value = alone[chosen[0]] - penalty * math.log(total + 1) / 2
    p = {w: [math.exp(x) for x in like[w]] for w in n}
    while len(chosen) < len(langs):
        mix = {w: max(sum(share[j] * p[w][j] for j in chosen), 1e-300) for w in n}
        rise = {j: sum(n[w] * p[w][j] / mix[w] for w in n) for j in range(len(langs)) if j not in chosen}
        best = max(rise, key=lambda j: (rise[j], -j))
        if rise[best] <= total * (1 + 1e-9):
            break
        trial = [*chosen, best]
        pi = {j: 1 / len(trial) for j in trial}
        for _ in range(12):
            got = dict.fromkeys(trial, 0.0)
            for w in n:
                z = sum(pi[j] * p[w][j] for j in trial)
                for j in trial:
                    got[j] += n[w] * pi[j] * p[w][j] / max(z, 1e-300)
            pi = {j: got[j] / max(sum(got.values()), 1e-300) for j in trial}
        now = sum(n[w] * math.log(max(sum(pi[j] * p[w][j] for j in trial), 1e-300)) for w in n) - penalty * len(trial) * math.log(total + 1) / 2
        if now <= value + 1e-9:
            break
        chosen, share, value = trial, pi, now
    order = sorted(chosen, key=lambda j: (-share[j], j))
    return langs[order[0]], share[order[0]], {langs[j] for j in chosen}


def test_op10_against_plain_em(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    taught = [r for r in docs if r.text and r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    langs = sorted({r.lang for r in taught})
    table = []
    for lang in langs:
        count = Counter(g for r in taught if r.lang == lang for w in plain_words(r.text) for g in plain_grams(w))
        total = sum(count.values()) + 0.1 * langid.BUCKETS
        table.append({g: math.log((c + 0.1) / total) for g, c in count.items()} | {None: math.log(0.1 / total)})
    got = {r.doc_id: r for r in entry.op10_langid(spark, SMALL).collect()}
    mixed = 0
    for r in docs:
        words = plain_words(r.text or "")
        mine = got[r.doc_id]
        assert mine.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not words:
            assert (mine.lang_pred, mine.score, mine.langs) == ("und", 0.0, "")
            continue
        lang, share, chosen = plain_language(words, table, langs)
        assert (mine.lang_pred, set(mine.langs.split(","))) == (lang, chosen)
        assert mine.score == pytest.approx(share, abs=1e-4)
        mixed += len(chosen) > 1
    assert len(langs) == 4


def jaccard_roots(texts: list[str], size: int = 5, percent: int = 80) -> list[int]:
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({" ".join(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {" ".join(w)} if w else set())
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(texts))]


@pytest.mark.parametrize("words", [6, 8])
def test_short_unrelated_texts_stay_apart(spark, words):
    """Majorities of few shingles are near by chance: 3,000 texts of six or eight words lose none."""
    rnd = random.Random(words)
    texts = [(k, " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(words))) for k in range(3000)]
    assert simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string")).count() == 3000


@pytest.mark.parametrize("block", [1 << 20, 3000])
def test_hot_group_in_small_blocks(spark, monkeypatch, block):
    """A group of near-copies that is many blocks, copies around 0.8, and short texts with one word more."""
    monkeypatch.setattr(settle, "BLOCK_BYTES", block)
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(90)]
    texts = []
    for _ in range(120):
        own = list(base)
        for _ in range(rnd.choice([0, 1, 1, 1, 2, 3])):
            own[rnd.randrange(90)] = word()
        texts.append(" ".join(own))
    short = [word() for _ in range(8)]
    texts += [" ".join(short), " ".join([*short, word()]), " ".join(short[:7]), " ".join([word() for _ in range(3)]), "", "  ", "one", "ONE"]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    texts = [texts[k] for k in order]
    want = sorted(set(jaccard_roots(texts)))
    got = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == want


@pytest.mark.parametrize("part", [2048, 7])
def test_only_sets_with_common_keys_are_compared(spark, monkeypatch, part):
    """No grid over all fingerprints; a line that all texts have, texts of up to 500 words, and copies on both sides of 0.8."""

    def grid(*a, **b):
        raise AssertionError("every fingerprint is held against every other")

    monkeypatch.setattr(simhash, "compared", grid)
    monkeypatch.setattr(simhash, "PART", part, raising=False)
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    line = " ".join(word() for _ in range(12))
    texts = [line]
    for n in [5, 8, 9, 10, 11, 12, 20, 40, 119, 121, 130, 250, 500] * 4:
        base = [word() for _ in range(n)]
        texts.append(" ".join([line, *base]))
        for share in (0.01, 0.02, 0.025, 0.03):
            own = [word() if rnd.random() < share else w for w in base]
            texts.append(" ".join([line, *own, *[word() for _ in range(rnd.randrange(3))]]))
        texts.append(" ".join([line, *base[: round(n * rnd.choice([0.78, 0.8, 0.82]))]]))
    roots = jaccard_roots(texts)
    assert 60 < len(set(roots)) < 250
    got = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == sorted(set(roots))


def test_similar_sets_have_keys_in_common():
    """Of sets that KEYS does not cut short as many as promised, exactly at the threshold; of others all but surely."""
    import numpy as np

    rnd = np.random.default_rng(5)
    for n in [*range(1, 140), 400, 5000]:
        for m in {n, -(-4 * n // 5), max(1, n - n // 10)}:
            both = min(m, -(-4 * (n + m) // 9))  # the fewest in common at 0.8
            if 10 * both < 8 * (n + m - both):
                continue
            h = rnd.integers(0, 2**63, n + m - both, dtype=np.uint64)
            a, b = (simhash.smallest(x, 8, 80) for x in (h[:n], np.concatenate([h[:both], h[n:]])))
            assert len(set(a.tolist()) & set(b.tolist())) >= min(8, -(-4 * max(n, m) // 5))
