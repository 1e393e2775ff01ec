"""The registered queries of this folder, whole, against plain versions: columns, folds, cuts and digests included."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

sp = pytest.importorskip("sentencepiece")

from sievework.llm import decontam, entry, langid, licenses, quality, simhash, toxicity, topk  # noqa: E402

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def big(k: int, rnd: random.Random) -> str:
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(k))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables with nulls, empty and long texts, repeated rows, ties, odd signs and clashing columns."""
    d, rnd = str(tmp_path_factory.mktemp("odd")), random.Random(3)
    shared, item = big(60, rnd), big(25, rnd)
    texts = [None, "", " \n\t ", "word " * 9000, "½ ² ³ Ⅷ", "\U0001F600" * 6 + " mit license", "é" * 300, "a b c d e f", "a b c d e f", shared + " " + big(30, rnd), shared + " " + big(40, rnd), big(20, rnd) + " " + item, item.upper(), big(50, rnd), "x" * 30_000]
    docs = [(k, t, "en" if k % 3 else "fr", "s", 0, "fp", 1) for k, t in enumerate(texts * 2)] + [(5, texts[5], None, None, None, None, None), (None, shared, None, None, None, None, None), (None, None, None, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, kept string, score int").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "f e d c b a"), (5, "word " * 3000)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    return d


def documents(spark, d):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()]


def in_fold(doc_id, k, at):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % k == at


NAMES = ["op1_quality", "op3_simhash", "op4_toxicity", "op6_decontamination", "op7_suffix_dedup", "op8_sentencepiece", "op9_licenses", "op10_langid"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    assert getattr(entry, name)(spark, empty).count() == 0


@pytest.mark.parametrize("name", [n for n in NAMES if n != "op6_decontamination"])
def test_every_row_once(spark, odd, name):
    got = [r.doc_id for r in getattr(entry, name)(spark, odd).collect()]
    assert Counter(got) == Counter(i for i, _ in documents(spark, odd))


def test_op3(spark, odd):
    def fingerprint(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        if not w:
            return 0
        parts = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
        c = Counter(parts)
        ones = [0] * 64
        for x, n in c.items():
            h = xxhash.xxh64_intdigest(x, 42)
            for b in range(64):
                ones[b] += n * (h >> b & 1)
        return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))

    for d in (odd, SMALL):
        docs = documents(spark, d)
        fps = [fingerprint(t) for _, t in docs]
        root = list(range(len(docs)))
        for i in range(len(docs)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and root[i] != root[j]:
                    lo, hi = sorted((root[i], root[j]))
                    root = [lo if r == hi else r for r in root]
        least = {r: min((docs[i][0] for i in range(len(docs)) if root[i] == r and docs[i][0] is not None), default=None) for r in set(root)}
        want = Counter((docs[i][0], f"{fps[i]:016x}", least[root[i]]) for i in range(len(docs)))
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in entry.op3_simhash(spark, d).collect()) == want


def test_op7(spark, odd):
    for d in (odd, SMALL):
        docs = [(i, t.encode()) for i, t in documents(spark, d)]
        c = Counter(t[k : k + 200] for _, t in docs for k in range(len(t) - 199))
        want = Counter()
        for i, t in docs:
            gone = np.zeros(len(t), bool)
            for k in range(len(t) - 199):
                if c[t[k : k + 200]] > 1:
                    gone[k : k + 200] = True
            spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
            want[i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()] += 1
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in entry.op7_suffix_dedup(spark, d).collect()) == want


def test_op8(spark, odd):
    lib = sp.SentencePieceProcessor(model_file=entry.piece_model())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for d in (odd, SMALL):
        want = Counter()
        for i, t in documents(spark, d):
            ids = lib.encode(t, add_bos=True, add_eos=True)
            want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids).encode())] += 1
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in entry.op8_sentencepiece(spark, d).collect()) == want


def coverage(text, item):
    """Share of the item's words under greedy tiles, and their number, by trying every pair of places."""
    a, b = (re.findall(r"[^\W_]+", x.lower()) for x in (item, text))
    least, tiles, total = min(5, len(a)), 0, 0
    if not a or not {tuple(a[k : k + least]) for k in range(len(a) - least + 1)} & {tuple(b[k : k + least]) for k in range(len(b) - least + 1)}:
        return 0.0, 0
    free_a, free_b = [True] * len(a), [True] * len(b)
    while True:
        best, run = (0, 0, 0), [0] * (len(b) + 1)
        for i in range(len(a) - 1, -1, -1):  # common runs from the back, row by row
            run = [run[j + 1] + 1 if free_a[i] and free_b[j] and a[i] == b[j] else 0 for j in range(len(b))] + [0]
            m = max(run)
            if m and m >= best[0]:
                best = (m, i, run.index(m))
        m, i, j = best
        if m < least:
            return total / len(a), tiles
        free_a[i : i + m], free_b[j : j + m] = [False] * m, [False] * m
        total, tiles = total + m, tiles + 1


def test_op6(spark, odd):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = {}
    for i, t in documents(spark, SMALL):
        for k, x in bench:
            share, tiles = coverage(t, x)
            if share >= 0.5:
                want[i, k] = (round(share, 6), tiles)
    assert want and {(r.doc_id, r.item_id): (r.coverage, r.n_tiles) for r in entry.op6_decontamination(spark, SMALL).collect()} == want
    got = Counter((r.doc_id, r.item_id) for r in entry.op6_decontamination(spark, odd).collect())
    assert got == Counter({(11, 1): 1, (26, 1): 1, (12, 1): 1, (27, 1): 1, (3, 5): 1, (18, 5): 1})


def test_tiles_without_a_list_are_the_same(monkeypatch):
    rnd = random.Random(4)
    for _ in range(400):
        k = rnd.choice([1, 2, 3, 6])
        w, t = ([rnd.choice("abcdefg"[: k + x]) for _ in range(rnd.randint(1, 50))] for x in (0, 1))
        items = decontam.Items([(1, " ".join(w))])
        monkeypatch.setattr(decontam, "PAIRS", 10**9)
        one = decontam.matches(" ".join(t), items, 0.3)
        monkeypatch.setattr(decontam, "PAIRS", 0)
        assert decontam.matches(" ".join(t), items, 0.3) == one


def test_op1(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = entry.op1_quality(spark, MEDIUM).collect()
    assert all(r.held_out == in_fold(r.doc_id, 5, 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert np.mean([r.predicted == labels[r.doc_id] for r in test]) > 0.93


def test_latent_axes_are_those_of_a_whole_decomposition():
    rng = np.random.default_rng(0)
    base = rng.standard_normal((4, 60))
    rows = []
    for _ in range(80):
        x = rng.standard_normal(4) @ base + 0.01 * rng.standard_normal(60)
        rows.append((np.arange(60), np.abs(x)))
    idf = np.ones(60)
    m = np.stack([w / np.linalg.norm(w) for _, w in rows])
    _, s, vt = np.linalg.svd(m, full_matrices=False)
    axes = quality._axes(rows, idf, 60, 4)
    assert np.allclose(np.linalg.norm(m @ axes, axis=0), s[:4], rtol=1e-3)
    assert np.allclose(np.abs((vt[:1] @ axes[:, :1]).item()), 1, atol=1e-3)


def test_quality_ties_do_not_depend_on_the_block():
    rng = np.random.default_rng(1)
    v = np.repeat(rng.standard_normal((5, 8)).astype(np.float32), 20, axis=0)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    model = quality.Model(np.ones(1), np.zeros((1, 8), np.float32), v, rng.integers(0, 2, 100).astype(float), 7, 8.0)
    x = v[::3]
    assert np.array_equal(model.score(x), np.concatenate([model.score(x[k : k + 1]) for k in range(len(x))]))


def test_op4(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = entry.op4_toxicity(spark, MEDIUM).collect()
    assert all(r.held_out == in_fold(r.doc_id, 3, 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert np.mean([r.predicted == labels[r.doc_id] for r in test]) > 0.93


def test_label_model_finds_accuracies_without_labels():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.55])
    spoke = rng.random((4000, 5)) < 0.7
    vote = np.where(rng.random((4000, 5)) < right, y[:, None], ~y[:, None]).astype(int)
    model = toxicity.LabelModel(np.where(spoke, vote, -1), 0.3, np.ones(4000))
    assert np.abs(model.accuracy - right).max() < 0.12 and np.argmin(model.accuracy) == 4
    assert ((model.posterior >= 0.5) == y).mean() > 0.93


def test_toxic_patterns():
    v = toxicity.Voters(["=idiot", "=loser"])
    at = lambda t: dict(zip(toxicity.PATTERNS, v.votes(t)[1]))
    assert at("a fine day")["none"] == 0 and at("you 1d10t")["leet"] == 1
    assert at("you idiot")["address"] == 1 and at("IDIOT!!!")["shout"] == 1 and at("idiot!!!")["marks"] == 1
    assert at("idiot and loser")["several"] == 1 and at("idiot " + "word " * 40)["single"] == -1
    assert dict(zip(toxicity.PATTERNS, toxicity.Voters(["=blorg"]).votes("blorg " + "word " * 40)[1]))["single"] == 0


def test_op10(spark, odd):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").collect()}
    rows = entry.op10_langid(spark, MEDIUM).collect()
    assert all(r.held_out == in_fold(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.97
    text = dict(documents(spark, odd))
    for r in entry.op10_langid(spark, odd).collect():
        letters = any(c.isalpha() for c in text[r.doc_id] or "") if r.doc_id is not None else None
        assert letters is None or (r.lang_pred == "und") == (not letters)


def test_languages_have_no_set_number():
    rng = np.random.default_rng(3)
    alphabets = ["abcde", "fghij", "klmno", "pqrst", "uvwxy"]
    word = lambda a: "".join(rng.choice(list(a), 5))
    table = np.full((langid.BUCKETS, 5), 0.1)
    for j, a in enumerate(alphabets):
        grams, _ = langid.word_grams([word(a) for _ in range(2000)])
        np.add.at(table[:, j], grams, 1)
    table = np.log(table / table.sum(axis=0)).astype(np.float32)
    docs = [Counter(word(a) for a in alphabets[:n] for _ in range(30)) for n in range(1, 6)]
    pi, k = langid.infer(docs, table, 12.0)
    assert k.tolist() == [1, 2, 3, 4, 5] and np.allclose(pi[4], 0.2, atol=0.02)
    both, _ = langid.infer([docs[1], docs[3]], table, 12.0)
    assert np.allclose(both, pi[[1, 3]])


def test_op9_by_words(spark, odd):
    places = [p.split() for p in licenses.PHRASES]
    text = Counter()
    for i, t in documents(spark, odd):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        at = sorted(k for p in places for k in range(len(w)) if w[k : k + len(p)] == p)
        text[i, len(w), len(at), at[0] if at else None, at[-1] if at else None] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word) for r in entry.op9_licenses(spark, odd).collect()) == text


def test_wrapped_license_is_found(spark):
    whole = dict(licenses.WHOLE)["mit-license"]
    rows = [(1, "intro words " * 40 + whole + " end" * 300), (2, " ".join(licenses.plain(whole).split()[:60])), (3, "released\n" + "x " * 30 + "\nunder the mit\n" + "y " * 30 + "license")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), windows=True).collect()}
    assert "mit-license" in got[1].labels.split(",") and got[1].score > 0.9
    assert "mit-license" not in got[2].labels and got[3].labels == ""


def test_huge_vectors_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (50, [1.0, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.search(df, df.vec_id % 50 == 0)


def test_topk_of_one_vector_and_repeated_ids(spark):
    rows = [(k, [0.5, -1.0, 2.0]) for k in range(40)] + [(60, [3.0, 0.0]), (60, [0.0, 0.0, 1.0]), (10, [-1.0])]
    v = [(i, np.floor(256 * np.array(x + [0.0] * (3 - len(x)))).astype(int)) for i, x in rows]
    want = []
    for q in sorted({i for i, _ in rows if i % 10 == 0}):
        s = sorted({(-int(a @ b), c) for i, a in v if i == q for c, b in v if c != q})[:5]
        want += [(q, k + 1, c, -x) for k, (x, c) in enumerate(s)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, df.vec_id % 10 == 0).collect()) == want


def test_simhash_block_plan():
    for size in (3, 10, 1000):
        counts = {20: 7, 21: 30, 24: 2, 25: 1, 33: 40}
        plan, pairs = simhash._block_plan(counts, 4, size)
        block = {pc: range(first, first + parts) for pc, first, parts, _, _ in plan}
        ends = {b: (lo, hi) for _, first, parts, lo, hi in plan for b in range(first, first + parts)}
        for a in counts:
            for b in counts:
                if abs(a - b) <= 4:
                    assert all(ends[x][0] <= y <= ends[x][1] for x in block[a] for y in block[b])
        assert pairs == sum(hi - b + 1 for b, (_, hi) in ends.items())
        assert all((y <= ends[x][1]) == (x >= ends[y][0]) for x in ends for y in ends if x <= y)
