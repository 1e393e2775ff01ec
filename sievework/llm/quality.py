"""Quality classification by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, class_counts, keep_rows, labelled_sample

#: Hash buckets of words and of form features.
WORDS, FORMS = 1 << 14, 1 << 12
_RUN = re.compile(r"(.)\1+")


def _hash(s: str, size: int) -> int:
    return zlib.crc32(s.encode()) % size


def _form(word: str) -> str:
    """Small letters as a, capitals as A, digits as 0, runs of one sign shortened: 'Thndou***' is 'Aa*'."""
    if word.isalpha():
        return "a" if word.islower() else "A" if word.isupper() else "Aa" if word[1:].islower() else "aA"
    return _RUN.sub(r"\1", "".join(["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in word]))


class Forms(dict):
    """Word to the numbers of its two features in one integer; emptied when it holds `most` words."""

    most = 100_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = _hash(word.lower(), WORDS) * FORMS + _hash("f" + _form(word), FORMS)
        return got


_RATES = ("again", "kinds", "caps", "signs", "long", "lines", "one")
_STEP = {(name, k): WORDS + _hash(f"r{name}{k}", FORMS) for name in _RATES for k in range(10)}


def features(text: str, forms: Forms) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (some may come twice) and weights of a whole text: words, word forms, and a few rates in steps."""
    words = text.split()
    if not words:
        return np.array([WORDS + _hash("empty", FORMS)]), np.array([4.0])
    counts = Counter(words)
    n, kinds = len(words), len(counts)
    both = np.fromiter(map(forms.__getitem__, counts), np.int64, kinds)
    times = np.fromiter(counts.values(), np.float64, kinds)
    form_n = np.bincount(both % FORMS, weights=times, minlength=FORMS)
    form = np.flatnonzero(form_n)
    rates = (
        sum(map(str.__eq__, words, words[1:])) / n,
        kinds / n,
        sum(map(str.isupper, words)) / n,
        1 - sum(map(str.isalnum, counts)) / kinds,
        min(1.0, (len(text) - n) / n / 20),
        min(1.0, text.count("\n") / n),
        sum(c for w, c in counts.items() if len(w) == 1) / n,
    )
    steps, parts = [], []
    for name, v in zip(_RATES, rates):
        # two neighbouring steps share the weight, so that near rates stay near
        x = np.sqrt(min(1.0, max(0.0, v))) * 8
        steps += [_STEP[name, int(x)], _STEP[name, int(x) + 1]]
        parts += [1.5 * (1 - x + int(x)), 1.5 * (x - int(x))]
    return (
        np.concatenate([both // FORMS, WORDS + form, steps]),
        np.concatenate([0.35 * (1 + np.log(times)) / np.sqrt(kinds), 3.0 * np.sqrt(form_n[form] / n), parts]),
    )


class Model:
    """Inverse document frequencies, the latent axes, and the labelled vectors with their labels and weights."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int, power: float, weights: np.ndarray | None = None):
        self.idf, self.axes, self.vectors, self.labels, self.k, self.power = idf, axes, vectors, labels, k, power
        self.weights = np.ones(len(labels)) if weights is None else weights

    def project(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(rows), self.axes.shape[1]), np.float32)
        for i, (at, w) in enumerate(rows):
            w = w * self.idf[at]
            out[i] = (w / np.linalg.norm(w)) @ self.axes[at]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, each with its similarity's power times its own weight."""
        if not len(self.labels):
            return np.full(len(x), 0.5)
        n = len(self.labels)
        k = min(self.k, n)
        out = np.empty(len(x))
        for a in range(0, len(x), block):
            # whole billionths, so that the shape of a block cannot tell; of equal ones the vector with the smaller number is nearer
            cos = np.rint(x[a : a + block].astype(float) @ self.vectors.T.astype(float) * 1e9).astype(np.int64)
            near = np.sort(np.argpartition(np.arange(n) - cos * n, k - 1, axis=1)[:, :k], axis=1)
            w = np.maximum(np.take_along_axis(cos, near, axis=1) * 1e-9, 1e-6) ** self.power * self.weights[near]
            out[a : a + block] = (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = 1500, rank: int = 48, k: int = 15, power: float = 8.0, label: str = "quality") -> Model:
    """Latent axes and labelled vectors from at most `per_class` labelled rows of either label.

    Both the sample and the broadcast model are bounded: 2 * per_class vectors of `rank` numbers and
    WORDS + FORMS axis rows.  Features are taken on the executors; the driver only sees their numbers.
    Rows without id, label or text (an empty one) follow labelled_sample(); repeated ids of `docs` vote once
    for each row; with no labelled row every score is 0.5.  Extra columns are not looked at.
    Votes are weighted back to the natural counts of the labels, so that scores do not depend on the bound.
    """
    natural = class_counts(labels, label, allowed)
    sample = labelled_sample(docs, labels, label, allowed, per_class)

    def take(batches):
        forms = Forms()
        for pdf in batches:
            got = [features(t if isinstance(t, str) else "", forms) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "at": [g[0].astype(np.int32) for g in got], "w": [g[1].astype(np.float32) for g in got]})

    got = sample.mapInPandas(take, "doc_id long, label int, at array<int>, w array<float>").toPandas().sort_values(["doc_id", "label"], kind="stable")
    size = WORDS + FORMS
    at, w = list(map(np.asarray, got["at"])), list(map(np.asarray, got["w"]))
    df = np.zeros(size)
    for a in at:
        df[a] += 1
    idf = np.log((1 + len(at)) / (1 + df)) + 1.0
    rows = [(a, x.astype(float)) for a, x in zip(at, w)]
    if not rows:
        return Model(idf, np.zeros((size, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), k, power)
    axes = _axes(rows, idf, size, rank)
    weights = np.array([natural[y] / min(natural[y], per_class) for y in got["label"]])
    model = Model(idf, axes, np.zeros((0, 1), np.float32), got["label"].to_numpy(float), k, power, weights)
    model.vectors = model.project(rows)
    return model


def _axes(rows: list, idf: np.ndarray, size: int, rank: int) -> np.ndarray:
    """Leading right singular vectors of the weighted rows, by randomised subspace iteration."""
    scaled = [(a, x * idf[a] / np.linalg.norm(x * idf[a])) for a, x in rows]
    index = np.concatenate([a for a, _ in scaled])
    value = np.concatenate([x for _, x in scaled])[:, None]
    n = np.array([len(a) for a, _ in scaled])
    at, row = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)

    def times(m):
        # in blocks of documents, so that the gathered rows stay small
        out = np.empty((len(n), m.shape[1]))
        for a in range(0, len(n), 128):
            b = min(a + 128, len(n))
            lo, hi = at[a], at[b - 1] + n[b - 1]
            out[a:b] = np.add.reduceat(value[lo:hi] * m[index[lo:hi]], at[a:b] - lo, axis=0)
        return out

    def back(m):
        out = np.zeros((size, m.shape[1]))
        for j in range(m.shape[1]):
            out[:, j] = np.bincount(index, weights=value[:, 0] * m[row, j], minlength=size)
        return out

    rank = min(rank, len(n))
    q = np.random.default_rng(7).standard_normal((size, min(rank + 8, len(n))))
    for _ in range(4):
        y, _ = np.linalg.qr(times(q))
        q = back(y)
    _, _, vt = np.linalg.svd(times(np.linalg.qr(q)[0]), full_matrices=False)
    return (np.linalg.qr(q)[0] @ vt.T)[:, :rank].astype(np.float32)


def add_score(docs: DataFrame, model: Model, keep: list[str], name: str = "score", block: int = 1024) -> DataFrame:
    """The columns `keep` of `docs` and a score from 0 to 1 of each whole text, called `name`.

    Null and empty texts are scored alike, by their one feature; very long ones are scored whole, a block of
    texts holding at least one.  Repeated rows get equal scores, null ids stay, a kept column called `name`
    is replaced, an empty table gives an empty result.  Of equally near vectors that with the smaller id
    votes.  Rows keep their number; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        forms, m = Forms(), shared.value

        def run(texts):
            return [np.concatenate([m.score(m.project([features(t, forms) for t in texts[a : a + block]])) for a in range(0, len(texts), block)])]

        return run

    return add_columns(docs, keep, f"`{name}` double", make)


def accepted(docs: DataFrame, model: Model, least: float, block: int = 1024) -> DataFrame:
    """The rows of `docs`, all columns, whose score is `least` or more; ties and odd rows as in add_score()."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        forms, m = Forms(), shared.value

        def run(texts):
            rows = [features(t or "", forms) for t in texts]
            return np.concatenate([m.score(m.project(rows[a : a + block])) for a in range(0, len(rows), block)]) >= least

        return run

    return keep_rows(docs, make)
