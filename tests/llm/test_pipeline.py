"""The pipeline's rows against plain versions of its stages, one after the other."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sp = pytest.importorskip("sentencepiece")

import corpus_pipeline  # noqa: E402
from sievework.llm import entry, quality, simhash  # noqa: E402
from sievework.llm.common import fold, table  # noqa: E402

DATA = "/root/testdata/sf0.001"


def votes(model, text):
    """All cosines, a full sort, and the vote."""
    at, w = quality.features(text, quality.Forms())
    x = np.zeros(model.axes.shape[1])
    for k, v in zip(at, w * model.idf[at]):
        x += v * model.axes[k]
    cos = sorted(((float(x @ v) / max(np.linalg.norm(x), 1e-12), y) for v, y in zip(model.vectors, model.labels)), reverse=True)[: model.k]
    weight = [max(c, 1e-6) ** model.power for c, _ in cos]
    return sum(a * y for a, (_, y) in zip(weight, cos)) / sum(weight)


def near_by_jaccard(docs):
    sets = [set(simhash.shingles(t.encode(), 5)) for _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return [d for i, d in enumerate(docs) if d[0] == min(docs[k][0] for k in range(len(docs)) if root[k] == root[i])]


def cut(docs, n=200):
    raw = [t.encode() for _, t in docs]
    c = Counter(hash(t[i : i + n]) for t in raw for i in range(len(t) - n + 1))
    out = []
    for (d, _), t in zip(docs, raw):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if c[hash(t[i : i + n])] > 1:
                gone[i : i + n] = True
        out.append((d, np.frombuffer(t, np.uint8)[~gone].tobytes().decode(errors="ignore")))
    return out


def holds(text, item):
    """Greedy tiling by trying every pair of places."""
    a, b = (re.findall(r"[^\W_]+", x.lower()) for x in (item, text))
    free_a, free_b, total = [True] * len(a), [True] * len(b), 0
    least = min(5, len(a))
    if not a or not {tuple(a[k : k + least]) for k in range(len(a) - least + 1)} & {tuple(b[k : k + least]) for k in range(len(b) - least + 1)}:
        return False
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return total >= 0.5 * len(a)
        for x in range(k):
            free_a[i + x] = free_b[j + x] = False
        total += k


def test_pipeline_against_plain_stages_by_jaccard(spark):
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, DATA).collect()}
    docs = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    model = quality.fit(table(spark, DATA, "documents"), table(spark, DATA, "labels"), fold(F.col("doc_id"), 5) != 0)
    docs = cut(near_by_jaccard([d for d in docs if votes(model, d[1]) >= corpus_pipeline.REJECT_BELOW]))
    bench = [r.text for r in table(spark, DATA, "benchmark").collect()]
    docs = [d for d in docs if not any(holds(d[1], b) for b in bench)]
    lib = sp.SentencePieceProcessor(model_file=entry.piece_model())
    assert got == {d: lib.encode(t, add_bos=True, add_eos=True) for d, t in docs}


def test_stages_on_odd_tables(spark):
    """Nulls, empty texts, repeated rows, extra columns: every stage but the last keeps the columns."""
    rows = [(1, None), (2, ""), (None, "a b c"), (None, None), (3, "x " * 500), (3, "x " * 500)]
    docs = spark.createDataFrame([(i, t, "en", None, 0, "more") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string")
    for start in (docs, docs.limit(0)):
        df = start
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, DATA)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert df.columns == docs.columns, name
        assert df.count() <= start.count()
