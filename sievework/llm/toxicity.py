"""Toxicity by weak supervision.

Many voters look at a text: a lexicon (words, word beginnings and endings; a few fixed ones, the rest mined
from labelled rows) and patterns.  A generative label model estimates each voter's accuracy, and the
correlations of voters, from how they agree, without any label; labels give the lexicon and the share of
toxic texts.  A linear classifier is trained on the model's posterior labels.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, class_counts, labelled_sample

WORD = re.compile(r"[^\W_]+")
#: Lengths of the word beginnings and endings that pattern voters look at.
LENGTHS = (4, 5, 6, 7, 8)
#: Words of the lexicon whatever the labels say.
LEXICON = ["idiot", "moron", "stupid", "loser", "scum", "pathetic", "worthless", "disgusting", "trash"]
#: Signs that stand for letters, and words of address.
LEET = str.maketrans("013457@$!", "oieastasi")
ADDRESS = frozenset("you your yours u ur du dich dir dein deine tu te ton ta toi vous tú ti usted eres".split())
#: Pattern voters: each says 1, 0, or nothing.
PATTERNS = ("none", "single", "several", "many", "leet", "shout", "marks", "address")
_LEET_WORD = re.compile(r"[^\s]*[0-9@$!][^\s]*")
_MARKS = re.compile(r"[!?]{3,}")


def terms_of(words: set[str]) -> set[str]:
    """All terms a set of words holds: =word, ^beginning, $ending."""
    out = {"=" + w for w in words}
    for n in LENGTHS:
        out |= {"^" + w[:n] for w in words if len(w) > n} | {"$" + w[-n:] for w in words if len(w) > n}
    return out


class Voters:
    """Finds which terms of a list a text holds, and how many different words they match."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.number = {t: k for k, t in enumerate(terms)}
        self.whole = {t[1:]: k for t, k in self.number.items() if t[0] == "="}
        self.begin = {n: {t[1:]: k for t, k in self.number.items() if t[0] == "^" and len(t) == n + 1} for n in LENGTHS}
        self.end = {n: {t[1:]: k for t, k in self.number.items() if t[0] == "$" and len(t) == n + 1} for n in LENGTHS}

    def fired(self, text: str) -> tuple[set[int], set[str], list[str]]:
        """Numbers of the terms, the different words that match, and all words."""
        every = WORD.findall(text.lower())
        words = set(every)
        hit: set[int] = set()
        matched: set[str] = set()
        for w in words & self.whole.keys():
            hit.add(self.whole[w])
            matched.add(w)
        for n in LENGTHS:
            if self.begin[n]:
                parts = {w[:n] for w in words} & self.begin[n].keys()
                if parts:
                    more = [w for w in words if len(w) > n and w[:n] in parts]
                    hit.update(self.begin[n][w[:n]] for w in more)
                    matched.update(more)
            if self.end[n]:
                parts = {w[-n:] for w in words} & self.end[n].keys()
                if parts:
                    more = [w for w in words if len(w) > n and w[-n:] in parts]
                    hit.update(self.end[n][w[-n:]] for w in more)
                    matched.update(more)
        return hit, matched, every

    def votes(self, text: str) -> tuple[set[int], list[int], list[float]]:
        """Numbers of the terms, the votes of PATTERNS (1, 0; -1: nothing), and a few rates."""
        hit, matched, every = self.fired(text)
        n, m = len(every), len(matched)
        out = dict.fromkeys(PATTERNS, -1)
        if not m:
            out["none"] = 0
        elif m == 1:
            one = next(iter(matched))
            out["single"] = 0 if one not in LEXICON and every.count(one) < 2 and n >= 20 else -1
        else:
            out["several"] = 1
            if m >= 3:
                out["many"] = 1
        if any(x.isdigit() or x in "@$!" for x in text):
            for w in _LEET_WORD.findall(text.lower()):
                plain = w.strip("!?.,;:").translate(LEET)
                if plain != w and plain in self.whole and w not in self.whole:
                    out["leet"] = 1
                    break
        if m:
            capitals = [w for w in WORD.findall(text) if len(w) > 2 and w.isupper() and w.lower() in matched]
            if capitals:
                out["shout"] = 1
            if _MARKS.search(text):
                out["marks"] = 1
            if any(a in ADDRESS and b in matched or a in matched and b in ADDRESS for a, b in zip(every, every[1:])):
                out["address"] = 1
        return hit, [out[k] for k in PATTERNS], [float(bool(hit)), float(np.log1p(m)), m / max(len(set(every)), 1)]


class LabelModel:
    """Generative model of votes given the unseen label, fitted by expectation-maximisation on agreement alone.

    `votes` holds 1 (toxic), 0 (not) or -1 (nothing).  A voter that speaks is right with its accuracy; one
    that says nothing tells nothing.  The first guess is the majority of the votes (a tie: the prior); the
    prior is given and stays.  Correlations given the label discount voters that speak together: a voter
    counts 1 / (1 + sum of its correlations with the others that spoke).
    """

    def __init__(self, votes: np.ndarray, prior: float, weight: np.ndarray, rounds: int = 25):
        yes, no = (votes == 1).astype(float), (votes == 0).astype(float)
        spoke = yes + no
        base = np.log(prior / (1 - prior))
        margin = yes.sum(axis=1) - no.sum(axis=1)
        p = np.where(margin > 0, 0.9, np.where(margin < 0, 0.1 * prior, prior))
        for _ in range(rounds):
            # how often a vote of either kind is right; as a rule it is, until it disagrees with others
            of_yes = np.clip(((weight * p) @ yes + 3.6) / (weight @ yes + 4.0), 0.02, 0.998)
            of_no = np.clip(((weight * (1 - p)) @ no + 3.6) / (weight @ no + 4.0), 0.02, 0.998)
            self.accuracy = ((weight @ yes) * of_yes + (weight @ no) * of_no + 0.9) / (weight @ spoke + 1.0)
            self.correlation = self._correlations(spoke, p, weight)
            share = 1.0 / (1.0 + spoke @ self.correlation)
            # a vote weighs its odds against those of chance: the present share of label 1, and of its rest
            mean = np.clip((weight @ p) / weight.sum(), 0.002, 0.998)
            chance = np.log(mean / (1 - mean))
            logit = base + (yes * share) @ (np.log(of_yes / (1 - of_yes)) - chance) - (no * share) @ (np.log(of_no / (1 - of_no)) + chance)
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        self.posterior = p

    @staticmethod
    def _correlations(v: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Positive correlations of voter pairs, averaged over the two labels by their weight."""
        total = np.zeros((v.shape[1], v.shape[1]))
        for q in (weight * p, weight * (1 - p)):
            s = q.sum()
            if s < 1e-9:
                continue
            c = v - (q @ v) / s
            cov = (c * q[:, None]).T @ c / s
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            total += s * np.maximum(cov / np.outer(sd, sd), 0)
        total /= weight.sum()
        np.fill_diagonal(total, 0)
        return total


class Model:
    """The lexicon, the classifier's weights, and what fitting found out about the voters.

    `agreement` is the share of the labelled rows (weighted to their natural counts) whose posterior label
    is theirs: the labels only check the label model.
    """

    def __init__(self, terms: list[str], weights: np.ndarray, agreement: float | None = None):
        self.terms, self.weights, self.agreement = terms, weights, agreement

    def row(self, voters: Voters, text: str) -> np.ndarray:
        hit, patterns, rates = voters.votes(text)
        x = np.zeros(len(self.terms) + len(PATTERNS) + 4)
        x[list(hit)] = 1.0
        x[len(self.terms) : -4] = [float(v >= 0) for v in patterns]
        x[-4:] = *rates, 1.0
        return x

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def mine(sample: DataFrame, have: dict[int, int], evidence: float = 5.0, few: int = 3) -> list[tuple[str, int, int]]:
    """(term, toxic rows, other rows) of every term that tells: no number of terms is set.

    Terms of all rows are counted on the executors.  A term is kept if it stands in `few` toxic rows or more
    and its log-likelihood ratio is over log(terms tested) + evidence, which chance reaches less than once,
    and if no kept shorter beginning or ending that holds it is as precise.
    """

    def count(batches):
        seen: Counter = Counter()
        for pdf in batches:
            for t, y in zip(pdf["text"], pdf["label"]):
                seen.update((x, int(y)) for x in terms_of(set(WORD.findall(t.lower()))))
                if len(seen) > 500_000:
                    yield pd.DataFrame([(x, y, n) for (x, y), n in seen.items()], columns=["term", "label", "n"])
                    seen.clear()
        yield pd.DataFrame([(x, y, n) for (x, y), n in seen.items()], columns=["term", "label", "n"])

    n = lambda y: F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0)).alias(f"n{y}")
    terms = sample.mapInPandas(count, "term string, label int, n long").groupBy("term").agg(n(1), n(0)).where(F.col("n1") >= few)
    share = have[1] / (have[0] + have[1])
    p = F.col("n1") / (F.col("n1") + F.col("n0"))
    gain = F.col("n1") * F.log(p / share) + F.when(F.col("n0") > 0, F.col("n0") * F.log((1 - p) / (1 - share))).otherwise(0.0)
    tested = terms.count()
    got = terms.where((p > share) & (gain > float(np.log(max(tested, 1)) + evidence))).collect()
    known = {r.term: (r.n1, r.n0) for r in got}
    precise = {t: a / (a + b) for t, (a, b) in known.items()}

    def shorter(t: str) -> list[str]:
        w = t[1:]
        heads = ["^" + w[:n] for n in LENGTHS if n < len(w)] if t[0] in "=^" else []
        ends = ["$" + w[-n:] for n in LENGTHS if n < len(w)] if t[0] in "=$" else []
        return heads + ends

    return sorted((t, a, b) for t, (a, b) in known.items() if not any(precise.get(x, 0.0) >= precise[t] for x in shorter(t)))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = 3000, evidence: float = 5.0, common: float = 0.05, label: str = "toxic") -> Model:
    """A classifier from at most `per_class` labelled rows of either label.

    The lexicon is LEXICON, and of the mined terms those that add toxic rows not yet covered, and those
    without a false row that stand in a share `common` of the toxic rows or more.  What reaches the driver
    are the terms kept and the sample's votes.  Rows without id, label or text take no part; repeated ids
    count once for each row; with rows of one label only, or none, every score is near that label, or 0.
    """
    sample = labelled_sample(docs, labels, label, allowed, per_class).select(F.coalesce("text", F.lit("")).alias("text"), "label").persist()
    try:
        have = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not have.get(1) or not have.get(0):
            return Model([], np.append(np.zeros(len(PATTERNS) + 3), 4.0 if have.get(1) else -4.0))
        natural = class_counts(labels, label, allowed)  # the sample is weighted back to these
        kept = [t for t, _, _ in mine(sample, have, evidence)]
        finder = Voters(kept)

        def hits(batches):
            for pdf in batches:
                yield pd.DataFrame({"label": pdf["label"], "hit": [sorted(finder.fired(t)[0]) for t in pdf["text"]]})

        got = sample.mapInPandas(hits, "label int, hit array<int>").collect()  # at most 2 * per_class rows
        y = np.array([r.label for r in got])
        v = np.zeros((len(got), len(kept)), bool)
        for i, r in enumerate(got):
            v[i, r.hit] = True
        chosen = _choose(v, y, common, (natural[0] / have[0]) / (natural[1] / have[1]))
        terms = sorted({kept[j] for j in chosen} | {"=" + w for w in LEXICON})
        model = Model(terms, np.zeros(len(terms) + len(PATTERNS) + 4))
        voters = Voters(terms)

        def look(batches):
            for pdf in batches:
                found = [voters.votes(t) for t in pdf["text"]]
                yield pd.DataFrame({"label": pdf["label"], "hit": [sorted(f[0]) for f in found], "patterns": [f[1] for f in found], "x": [model.row(voters, t) for t in pdf["text"]]})

        back = sample.mapInPandas(look, "label int, hit array<int>, patterns array<int>, x array<double>").toPandas()
        back = back.assign(o=[np.asarray(x).tobytes() for x in back["x"]]).sort_values(["label", "o"])  # the same order in every run
        votes = np.full((len(back), len(terms)), -1)
        for i, h in enumerate(back["hit"]):
            votes[i, list(h)] = 1
        y = back["label"].to_numpy()
        weight = np.where(y == 1, natural[1] / have[1], natural[0] / have[0])
        weight /= weight.mean()
        prior = float(np.clip(natural[1] / (natural[0] + natural[1]), 0.002, 0.998))
        posterior = LabelModel(np.column_stack([votes, np.stack(list(back["patterns"]))]), prior, weight).posterior
        model.weights = _logistic(np.stack(list(back["x"])), posterior, weight)
        model.agreement = float((weight * ((posterior >= 0.5) == (y == 1))).sum() / weight.sum())
        return model
    finally:
        sample.unpersist()


def _choose(v: np.ndarray, y: np.ndarray, common: float, ratio: float) -> list[int]:
    """First the terms that each add most toxic rows not yet covered, each false row (times its weight) against two of them; then the common ones without a false row."""
    pos, neg = v[y == 1], v[y == 0]
    left, chosen = np.ones(len(pos), bool), []
    cost = 2.0 * ratio * neg.sum(axis=0)
    while left.any() and v.shape[1]:
        gain = pos[left].sum(axis=0) - cost
        gain[chosen] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] < 2:
            break
        chosen.append(j)
        left &= ~pos[:, j]
    rest = np.flatnonzero((cost == 0) & (pos.sum(axis=0) >= common * len(pos)))
    return chosen + [int(j) for j in rest if int(j) not in set(chosen)]


def _logistic(x: np.ndarray, p: np.ndarray, weight: np.ndarray, ridge: float = 0.02, rounds: int = 40) -> np.ndarray:
    """Soft-label logistic regression by Newton steps; the constant is not penalised."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (s - p)) + keep * w
        h = (x * (weight * s * (1 - s) + 1e-9)[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def add_score(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """The columns `keep` of `docs` and a score from 0 to 1 of each whole text, called `name`.

    Null and empty texts hold no term; very long ones are scored whole; repeated rows get equal scores;
    null ids stay; a kept column called `name` is replaced; an empty table gives an empty result.  Rows
    keep their number; no shuffle; the model grows with the lexicon only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        voters = Voters(m.terms)
        return lambda texts: [m.score(np.stack([m.row(voters, t) for t in texts]))]

    return add_columns(docs, keep, f"`{name}` double", make)
