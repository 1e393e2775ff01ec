"""Language identification by multilingual mixture inference."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns

#: Runs of letters and of numbers that are no decimal digits (halves, Roman ones): letters_of() drops the latter.
RUNS = re.compile(r"[^\W\d_]+")
#: Languages beyond which the broadcast table would be over 512 MB: an error, not a cut.
MOST_LANGUAGES = 1000
ORDERS, BUCKETS = (1, 2, 3, 4), 1 << 17


def letters_of(text: str) -> list[str]:
    """The words of a text in small letters: runs of letters (of any script), whole."""
    out = []
    for w in RUNS.findall(text.lower()):
        if w.isalpha():
            out.append(w)
        else:
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the words (with a boundary mark on both sides), and each one's word."""
    joined = "\x02" + "\x03\x02".join(words) + "\x03"
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    grams, owners = [], []
    for n in ORDERS:
        if len(cp) < n:
            break
        h = np.full(len(cp) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + cp[k : len(cp) - n + 1 + k]
        inside = word[: len(h)] == word[n - 1 :]
        h = (h[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)
        grams.append(h.astype(np.int64) & (BUCKETS - 1))
        owners.append(word[: len(inside)][inside])
    return np.concatenate(grams), np.concatenate(owners)


def train(docs: DataFrame, allowed: Column, per_language: int = 1500) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and the log-probability of each n-gram bucket in each, BUCKETS x languages.

    Fitted on the rows with text, language and `allowed`; of each language a sample by the hash of the
    id, expected to hold `per_language` rows at most (all, if there are fewer).  What comes to the driver
    is one count for each language, and the n-gram counts: at most BUCKETS for each language.
    """
    rows = docs.where(allowed & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the table is made for {MOST_LANGUAGES} at most")
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / counts[k]))]), F.col("lang")), F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def count(batches):
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                words: Counter = Counter()
                for t in part["text"]:
                    words.update(letters_of(t))
                if not words:
                    continue
                grams, owner = word_grams(list(words))
                n = np.bincount(grams, weights=np.fromiter(words.values(), float, len(words))[owner], minlength=BUCKETS)
                some = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "gram": some, "n": n[some].astype(np.int64)})

    got = rows.where(draw < share).select(F.make_valid_utf8("text").alias("text"), "lang").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((BUCKETS, len(langs)), 0.1)
    np.add.at(table, (got["gram"].to_numpy(np.int64), got["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(np.int64)), got["n"].to_numpy(float))
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _mixture(like: np.ndarray, n: np.ndarray, at: np.ndarray, doc: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document, and how steeply the latter rises with each language's share.

    like: words x languages, at: where documents begin.
    """
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        r = like * pi[doc]
        r *= (n / np.maximum(r.sum(axis=1), 1e-300))[:, None]
        pi = np.add.reduceat(r, at, axis=0)
        pi /= np.maximum(pi.sum(axis=1, keepdims=True), 1e-300)
    mix = np.maximum((like * pi[doc]).sum(axis=1), 1e-300)
    return pi, np.add.reduceat(n * np.log(mix), at), np.add.reduceat(like * (n / mix)[:, None], at, axis=0)


def infer(counters: list[Counter], table: np.ndarray, penalty: float, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) under the chosen language set; zeros for a document without words.

    The set starts with the likeliest language.  As long as the penalised log-likelihood (less penalty *
    languages * log(words) / 2) rises, the language joins along whose share the likelihood rises most, and
    the proportions of the set are fitted anew by expectation-maximisation over the document's words; where it
    rises along none, no set is likelier.  Any number of languages up to all can be chosen; ties go to the
    smaller set and to the language first in the alphabet.
    """
    langs = table.shape[1]
    out, chosen = np.zeros((len(counters), langs)), np.zeros(len(counters), np.int64)
    full = [i for i, c in enumerate(counters) if c]
    if not full or not langs:
        return out, chosen
    known: dict[str, int] = {}
    index = np.array([known.setdefault(w, len(known)) for i in full for w in counters[i]], np.int64)
    n = np.array([x for i in full for x in counters[i].values()], float)
    size = np.array([len(counters[i]) for i in full])
    at, doc = np.cumsum(size) - size, np.repeat(np.arange(len(full)), size)
    score = np.zeros((len(known), langs))
    words = list(known)
    for k in range(0, len(words), 20_000):
        part = words[k : k + 20_000]
        grams, owner = word_grams(part)
        for j in range(langs):
            score[k : k + len(part), j] = np.bincount(owner, weights=table[grams, j], minlength=len(part))
    score -= score.max(axis=1, keepdims=True)
    score = np.maximum(score, -30.0)[index]
    like = np.exp(score)
    tokens = np.add.reduceat(n, at)
    each = np.add.reduceat(score * n[:, None], at, axis=0)  # log-likelihood of each language alone
    first = each.argmax(axis=1)
    here = np.arange(len(full))
    best_pi = np.zeros((len(full), langs))
    best_pi[here, first] = 1.0
    value, count = each[here, first] - penalty * np.log(tokens + 1) / 2, np.ones(len(full), np.int64)
    rise = np.add.reduceat(like * (n / np.maximum(like[np.arange(len(doc)), first[doc]], 1e-300))[:, None], at, axis=0)
    live = here  # documents whose set may still grow
    for k in range(2, langs + 1):
        slope = np.where(best_pi[live] > 0, -np.inf, rise[live])
        on = slope.max(axis=1) > tokens[live] * (1 + 1e-9)
        live, slope = live[on], slope[on]
        if not len(live):
            break
        allowed = (best_pi[live] > 0).astype(float)
        allowed[np.arange(len(live)), slope.argmax(axis=1)] = 1.0
        mine = np.isin(doc, live)
        sub_n = size[live]
        sub_at = np.cumsum(sub_n) - sub_n
        p, ll, up = _mixture(like[mine], n[mine], sub_at, np.repeat(np.arange(len(live)), sub_n), allowed, rounds)
        now = ll - penalty * k * np.log(tokens[live] + 1) / 2
        better = now > value[live] + 1e-9
        live = live[better]
        best_pi[live], value[live], rise[live], count[live] = p[better], now[better], up[better], k
    out[full], chosen[full] = best_pi, count
    return out, chosen


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, penalty: float = 12.0, block_bytes: int = 1_000_000) -> DataFrame:
    """(doc_id, lang_pred, score, langs): the language with the largest share in each whole text.

    score is that share; langs is the chosen set, largest share first.  A null text, one without a
    letter, and every text when nothing was learned: lang_pred `und`, score 0, langs empty.  Ties go to
    the language first in the alphabet.  Repeated rows and null ids stay; other columns are left out.
    An empty table gives an empty result; very long texts and words are whole.  The broadcast table has
    BUCKETS rows whatever the corpus, and a column for each language (MOST_LANGUAGES at most).
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def make():
        grams = shared.value

        def run(texts):
            pi, k = infer([Counter(letters_of(t)) for t in texts], grams, penalty)
            order = np.argsort(-pi, axis=1, kind="stable")
            some = [i if k[i] else None for i in range(len(texts))]
            return [
                ["und" if i is None else langs[order[i, 0]] for i in some],
                [0.0 if i is None else float(min(1.0, pi[i, order[i, 0]])) for i in some],
                ["" if i is None else ",".join(langs[j] for j in order[i, : k[i]]) for i in some],
            ]

        return run

    return add_columns(docs, ["doc_id"], "lang_pred string, score double, langs string", make, block_bytes=block_bytes)
