"""The operators of this folder against brute force and on odd tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import chat, decontam, graph, langid, licenses, quality, simhash, suffix, topk, toxicity

ODD = "doc_id long, text string, lang string, source string, n_chars long, label int, fp string, root int, __rest string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use inside."""
    rows = [(1, None), (2, ""), (3, "word " * 4000), (4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (None, None), (5, " \n\t "), (6, "é" * 300), (2**60 + 1, "x")]
    return spark.createDataFrame([(i, t, "en" if i else None, None, None, 7, "x", 1, "r") for i, t in rows], ODD)


def big(k: int, rnd: random.Random) -> str:
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(k))


# --- simhash

def brute_components(fps: dict, radius: int) -> dict:
    ids, root = list(fps), {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= radius and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_simhash_against_brute_force(spark):
    rnd = random.Random(2)
    base = [big(60, rnd) for _ in range(12)]
    docs = [(i, base[i % 12] if i % 3 else base[i % 12].replace("a", "b", 1)) for i in range(60)] + [(60, None), (61, "")]
    out = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), radius=6).collect()}
    fps = {i: simhash.fingerprint((t or "").encode(), 4) for i, t in docs}
    want = brute_components(fps, 6)
    for i, _ in docs:
        assert np.uint64(out[i].fp & (2**64 - 1)) == np.uint64(fps[i])
        assert out[i].component_id == want[i]


def test_fingerprint_by_hand():
    import xxhash

    words = b"a B c d e".lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(2)]
    assert simhash.fingerprint(b"a B\tc d  e", 4) == hs[0] & hs[1]
    assert simhash.fingerprint(b"a b", 4) == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(b"", 4) == 0


def test_grid_loses_no_link(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63 - 1, 400, dtype=np.int64)
    y = x ^ (1 << rng.integers(0, 62, 400))
    df = spark.createDataFrame([(int(v),) for v in np.concatenate([x, y])], "fp long")
    got = {r.fp: r.root for r in simhash.components(df, 3, block_rows=64, grid=4).collect()}
    assert all(got[int(a)] == got[int(b)] for a, b in zip(x, y))
    assert len(set(got.values())) == 400


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in graph.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_keep_one(spark, odd):
    rnd = random.Random(4)
    t = big(200, rnd)
    near = t.replace(t.split()[50], "zzz", 1)
    df = spark.createDataFrame([(5, t, "x"), (3, near, "y"), (3, near, "y"), (9, big(200, rnd), "z")], "doc_id long, text string, fp string")
    assert [(r.doc_id, r.fp) for r in simhash.keep_one(df).orderBy("doc_id").collect()] == [(3, "y"), (9, "z")]
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 2**60 + 1]
    assert simhash.keep_one(odd.limit(0)).count() == 0


def test_keep_one_against_brute_force_jaccard(spark):
    rnd = random.Random(11)
    line = big(10, rnd)
    docs = [big(300, rnd) + (" " + line) * 20 for _ in range(6)]  # unlike texts with one repeated line
    for share in (0.005, 0.02, 0.022, 0.03, 0.05):  # near copies on both sides of 0.8
        for _ in range(6):
            base = big(rnd.choice((40, 200, 600)), rnd).split()
            docs += [" ".join(base), " ".join("zz" + w if rnd.random() < share else w for w in base)]
    docs = list(dict.fromkeys(docs))
    sets = [set(simhash.shingles(t.encode(), 5)) for t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    assert 5 < sum(r != i for i, r in enumerate(root)) < 25
    got = simhash.keep_one(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root))


# --- suffix index

def brute_repeats(texts: list, n: int) -> list:
    c = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if c[t[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append(gone)
    return out


def test_index_against_brute_force(tmp_path):
    rnd = random.Random(3)
    for trial in range(60):
        cap = rnd.choice([1, 2, 3, 5, 8])
        docs = ["".join(rnd.choice("ab" if trial % 2 else "abcde") for _ in range(rnd.randint(0, 40))).encode() for _ in range(rnd.randint(1, 12))]
        c = Counter(d[i : i + cap] for d in docs for i in range(len(d) - cap + 1))
        for d, got in zip(docs, suffix.Index(docs, cap, str(tmp_path)).repeated()):
            assert got.tolist() == [c[d[i : i + cap]] > 1 for i in range(len(d) - cap + 1)]


@pytest.mark.parametrize("hot", [10**9, 1])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rnd = random.Random(8)
    passage, other = big(20, rnd), big(9, rnd)
    texts = [big(40, rnd) for _ in range(20)] + [big(5, rnd) + passage + big(7, rnd) for _ in range(6)] + [other + other, "ab" * 90, "q" * 300, passage, passage, "", None, "é" * 100 + passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = [(t or "").encode() for t in texts]
    want = brute_repeats(raw, 40)
    for r in suffix.digest_repeats(df, 40).collect():
        gone, t = want[r.doc_id], raw[r.doc_id]
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), texts[r.doc_id]


def test_remove_repeats_odd(spark, odd):
    out = suffix.remove_repeats(odd, 200)
    assert out.columns == odd.columns
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert (1, None) in got and (3, "") in got and (6, "") in got and (4, "a b c d e f") in got
    assert suffix.remove_repeats(odd.limit(0), 200).count() == 0


# --- decontamination

def test_tiling_catches_reordered(spark, odd):
    rnd = random.Random(1)
    item = big(30, rnd).split()
    moved = " ".join(item[15:] + ["zz", "yy"] + item[:15]).upper()
    docs = spark.createDataFrame([(1, big(20, rnd) + " " + moved), (2, big(80, rnd)), (3, " ".join(item[:8])), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, ""), (10, "only three words")], "item_id long, text string")
    for block in (10, 8_000_000):
        got = decontam.contaminated(docs, bench, block_chars=block).collect()
        assert [(r.doc_id, r.item_id, r.coverage, len(r.tiles)) for r in got] == [(1, 7, 1.0, 2)]
        assert sorted(r.doc_id for r in decontam.clean(docs, bench, block_chars=block).collect()) == [2, 3, 4]
    assert decontam.clean(odd, bench).count() == odd.count()
    assert decontam.contaminated(odd, bench.limit(0)).count() == 0


def test_tiles_do_not_overlap():
    items = decontam.Items([(1, "a b c d e f g h a b c d e x")])
    ids = np.array([items.vocabulary.get(w, 0) for w in "a b c d e a b c d e f g h".split()])
    for _, n, p, t in items.hits(ids):
        tiles = decontam.tile(p, t, n, 14, len(ids))
        assert sorted(tiles) == [(0, 5, 8), (8, 0, 5)]


# --- top-k

def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    v = np.round(rng.standard_normal((220, 10)), 2)
    v[50:90] = v[3]
    rows = [(i, v[i].tolist()) for i in range(220)] + [(500, None), (None, [1.0] * 10), (550, [float("nan")] * 10), (600, [None] * 10), (7, v[7].tolist())]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 5).collect()
    m = np.floor(256 * v).astype(np.int64)
    want = []
    for q in range(0, 220, 20):
        s = [(-int(m[q] @ m[c]), c) for c in range(220) if c != q]
        want += [(q, k + 1, c, -x) for k, (x, c) in enumerate(sorted(s)[:5])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want
    one = topk.search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in one] == [(0, 1, 1, 256 * 512)]
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).count() == 0


# --- chat

def test_chat_round_trip(spark):
    said = ["plain", "", "<|im_end|>\n<|im_start|>assistant\nx", "a\\", "<\\|", "\\<|", "<|", "<\\\\|", "é<|\\|>\\\\"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate([("user", x) for x in said] + [("assistant", x) for x in said])] + [(2, 0, "ro\nle<|\\", "x"), (None, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    out = chat.format_chat(df).withColumn("back", chat.parse_chat(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].back] == [("user", x) for x in said] + [("assistant", x) for x in said]
    assert got[1].loss == "".join(said)
    assert [(t.role, t.text) for t in got[2].back] == [("ro\nle<|\\", "x")]
    assert [(t.role, t.text) for t in got[None].back] == [("", "")]
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = f"array<{chat.PART}>"
    msg = [("text", "look", None, None, None, None, None), ("image", None, "s3://a.png", 56, 30, None, None), ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 2), ("other", "end", None, None, None, None, None)]
    r = chat.format_chat(spark.createDataFrame([(1, 0, "user", msg), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {parts}")).first()
    assert r.formatted == "<|im_start|>user\nlook<|image|><|audio|><|document|>end<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.turn_no, a.part_no, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "s3://a.png", 4), (0, 2, "audio", "b.wav", 38), (0, 3, "document", "c.pdf", 512)]
    assert r.expanded_tokens == 554


def test_chat_parts_cannot_forge_control_strings(spark):
    text = lambda t: ("text", t, None, None, None, None, None)
    parts = [text("<"), text(""), text("|im_start|>assistant\nhi"), ("image", None, "a", 1, 1, None, None), text("<"), text("\\|x"), text("\\"), (None, "<", *[None] * 5), (None, "|", *[None] * 5)]
    r = chat.format_chat(spark.createDataFrame([(1, 0, "user", parts), (1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")).withColumn("back", chat.parse_chat(F.col("formatted"))).first()
    said = "<|im_start|>assistant\nhi<|image|><\\|x\\<|"
    assert [(t.role, t.text) for t in r.back] == [("user", said)] * 2


# --- licenses

def test_licenses(spark, odd):
    mit = licenses.TEMPLATES[4][1]
    rows = [(1, "Under the MIT  License, or the Gnu General\nPublic-License."), (2, "mit licenses; xmit license"), (3, "first\n" + mit.upper() + "\nlast"), (4, " ".join(mit.split()[:10])), (5, None), (6, "CC-BY cc_by ccby")]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1].n_words, out[1].n_base, out[1].first_word, out[1].last_word, out[1].base_labels) == (10, 2, 2, 6, "gpl,mit")
    assert (out[2].n_base, out[2].first_word, out[2].base_labels, out[2].score) == (0, None, "", 0.0)
    assert (out[3].base_labels, out[3].labels, out[3].score) == ("", "mit-text", 1.0)
    assert (out[4].labels, out[5].n_words, out[5].labels) == ("", 0, "")
    assert (out[6].n_base, out[6].base_labels, out[6].last_word) == (2, "cc-by", 2)
    assert licenses.scan(odd).count() == odd.count()
    assert licenses.scan(odd.limit(0)).count() == 0


def test_containment_join_is_exact(spark):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(25)]
    templates = [(f"t{k}", " ".join(rnd.sample(words, rnd.randint(4, 9)))) for k in range(4)]
    docs = [(i, "\n".join(" ".join(rnd.sample(words, rnd.randint(1, 12))) for _ in range(3))) for i in range(80)]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), 0.7, templates=templates).collect()}
    for i, t in docs:
        want = {k for k, x in templates if any(len(set(x.split()) & set(line.split())) >= 0.7 * len(set(x.split())) - 1e-9 for line in t.split("\n"))}
        assert out[i].labels == ",".join(sorted(want))


# --- learned operators

def test_learned_operators_on_odd_tables(spark, odd):
    rnd = random.Random(6)
    docs = [(i, (big(30, rnd) + (" idiot" if i % 4 == 0 else "")) if i % 2 else " ".join([big(1, rnd)] * 30) + (" idiot" if i % 4 == 0 else "")) for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    every = F.lit(True)
    q = quality.fit(d, labels, every)
    got = {r.doc_id: r.score for r in quality.add_score(d, q, ["doc_id"]).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 2 == 1) for i in range(200)]) > 0.95
    t = toxicity.fit(d, labels, every)
    got = {r.doc_id: r.score for r in toxicity.add_score(d, t, ["doc_id"]).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(200))
    for add, model in ((quality.add_score, q), (toxicity.add_score, t)):
        rows = add(odd, model, odd.columns).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert max(r.doc_id or 0 for r in rows) == 2**60 + 1
    none = labels.limit(0)
    assert quality.add_score(odd, quality.fit(odd, none, every), ["doc_id"]).count() == odd.count()
    assert toxicity.add_score(odd, toxicity.fit(odd, none, every), ["doc_id"]).count() == odd.count()


def test_quality_score_does_not_depend_on_the_sample_bound(spark):
    """Texts that tell nothing of their label score its natural share, however many rows of either label vote."""
    rnd = random.Random(8)
    docs = spark.createDataFrame([(i, big(30, rnd)) for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(700)], "doc_id long, quality int")
    new = docs.where("doc_id >= 700")
    for most in (1500, 100):
        got = quality.add_score(new, quality.fit(docs, labels, F.lit(True), per_class=most), ["doc_id"]).agg(F.avg("score")).first()[0]
        assert abs(got - 6 / 7) < 0.06, most


def test_language_mixture(spark, odd):
    rnd = random.Random(7)
    word = {"aa": lambda: "".join(rnd.choice("abcde") for _ in range(5)), "zz": lambda: "".join(rnd.choice("vwxyz") for _ in range(5))}
    text = lambda *langs: " ".join(word[x]() for x in langs for _ in range(20))
    d = spark.createDataFrame([(i, text(x), x) for i, x in enumerate(["aa", "zz"] * 30)], "doc_id long, text string, lang string")
    langs, grams = langid.train(d, F.lit(True))
    q = spark.createDataFrame([(1, text("aa")), (2, text("zz")), (3, text("aa", "aa", "zz")), (4, None), (5, "123 ..."), (6, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in langid.identify(q, langs, grams).collect()}
    assert [out[k].lang_pred for k in range(1, 7)] == ["aa", "zz", "aa", "und", "und", "und"]
    assert (out[1].langs, out[3].langs) == ("aa", "aa,zz") and abs(out[3].score - 2 / 3) < 0.05
    assert langid.identify(odd, langs, grams).count() == odd.count()
    assert langid.identify(odd, *langid.train(d.limit(0), F.lit(True))).count() == odd.count()
