"""Pronoun-bias evaluation over supplied model scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import CLASSES, GENDERS, all_pronouns, gender_class, masked, rewrite, strip_punctuation, tokens


def masked_rows(sentences: DataFrame, key: list[str], text: str = "sentence") -> DataFrame:
    """One row for each pronoun: key, pos, original (as a plain word), gender, masked_sentence."""
    words = sentences.select(*key, tokens(F.col(text)).alias("__w"))
    flat = words.select(*key, "__w", F.posexplode("__w").alias("pos", "__t")).withColumn("original", strip_punctuation(F.col("__t")))
    return flat.where(F.col("original").isin(all_pronouns())).select(*key, "pos", "original", gender_class(F.col("original")).alias("gender"), masked(F.col("__w"), F.col("pos")).alias("masked_sentence"))


def variants(sentences: DataFrame, text: str = "sentence", gender: str = "gender") -> DataFrame:
    """Each sentence once for every gender, its pronouns rewritten from its own to that one.

    The gender side is a list of three, so each row becomes three without a join.
    """
    rows = sentences.withColumn("variant", F.explode(F.array(*[F.lit(g) for g in GENDERS])))
    out = F.col(text)
    for a in GENDERS:
        for b in GENDERS:
            if a != b:
                out = F.when((F.col(gender) == a) & (F.col("variant") == b), rewrite(F.col(text), a, b)).otherwise(out)
    return rows.withColumn("variant_sentence", out)


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by the largest (F8).

    Each step's value is the one element of an array, so that it is computed once and not for every candidate.
    """
    bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    shares = lambda e: bind(total(e), lambda t: F.transform(e, lambda x: x / t))
    return bind(logits, lambda v: bind(F.array_max(v), lambda m: bind(F.transform(v, lambda x: F.exp(x - m)), shares)))


def top_k(rows: DataFrame, group: list[str], k: int, score: str = "prob", token: str = "token") -> DataFrame:
    """The k best tokens of each group with their rank, ties by the token."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), token)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best(token: Column, prob: Column, k: int) -> Column:
    """The k best of a mask's tokens as an array of (token, prob) by rank, ties by the token.

    top_k() for arrays of tokens and probabilities: a mask stays one row, so nothing is sorted or shuffled.
    """
    pairs = F.array_sort(F.zip_with(token, prob, lambda t, p: F.struct((-p).alias("least"), t.alias("token"))))
    return F.transform(F.slice(pairs, 1, k), lambda x: F.struct(x["token"].alias("token"), (-x["least"]).alias("prob")))


def best_mass(masks: DataFrame, column: str = "best") -> DataFrame:
    """`masks` with the columns of gender_mass(), from each mask's array of best()."""
    def total(g: str) -> Column:
        own = F.filter(column, lambda x: gender_class(F.lower(x["token"])) == g)
        return F.aggregate(own, F.lit(0.0), lambda a, x: a + x["prob"])

    return _with_shares(masks.select("*", *[total(x).alias(f"{x}_raw") for x in GENDERS]))


def gender_mass(top: DataFrame, group: list[str], score: str = "prob", token: str = "token") -> DataFrame:
    """Raw and normalised probability of each gender among the top tokens; zeros where there is none."""
    g = gender_class(F.lower(F.col(token)))
    raw = top.groupBy(*group).agg(*[F.coalesce(F.sum(F.when(g == x, F.col(score))), F.lit(0.0)).alias(f"{x}_raw") for x in GENDERS])
    return _with_shares(raw)


def _with_shares(raw: DataFrame) -> DataFrame:
    total = F.col("male_raw") + F.col("female_raw") + F.col("neutral_raw")
    return raw.withColumn("total_gender_prob", total).withColumns({f"{x}_prob": F.when(total > 0, F.col(f"{x}_raw") / total).otherwise(0.0) for x in GENDERS})


def preferred(columns: dict[str, Column], largest: bool = True) -> Column:
    """The gender with the largest (or smallest) value; ties in the order male, female, neutral."""
    sign = -1 if largest else 1
    items = F.array(*[F.struct((c * sign).alias("v"), F.lit(i).alias("o"), F.lit(g).alias("g")) for i, (g, c) in enumerate(columns.items())])
    return F.array_min(items)["g"]


def weighted_gender(mass: DataFrame, key: list[str]) -> DataFrame:
    """Mean gender probabilities of a sentence, masks weighted by their gendered mass, and the preference."""
    s = mass.groupBy(*key).agg(*[F.sum(f"{x}_raw").alias(f"__{x}") for x in GENDERS], F.sum("total_gender_prob").alias("__t"))
    out = s.withColumns({f"{x}_mean": F.when(F.col("__t") > 0, F.col(f"__{x}") / F.col("__t")).otherwise(0.0) for x in GENDERS})
    return out.withColumn("preferred", preferred({x: F.col(f"{x}_mean") for x in GENDERS})).drop("__t", *[f"__{x}" for x in GENDERS])


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def log_likelihood(loss: Column, length: Column) -> Column:
    """Minus loss times length, as the metric is defined."""
    return -loss * length


def pick_variant(scored: DataFrame, key: str, variant: str = "variant", ppl: str = "perplexity") -> DataFrame:
    """Perplexities of the variants side by side and the variant with the smallest."""
    wide = scored.groupBy(key).pivot(variant, GENDERS).agg(F.first(ppl))
    return wide.withColumn("preferred", preferred({g: F.coalesce(F.col(g), F.lit(float("inf"))) for g in GENDERS}, largest=False))


def shares(df: DataFrame, column: str) -> DataFrame:
    """(column, n, share) of every value."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def baseline(df: DataFrame, column: str) -> DataFrame:
    """Chance agreement: the sum of squared shares; a third for an empty table."""
    return shares(df, column).agg(F.coalesce(F.sum(F.col("share") * F.col("share")), F.lit(1.0 / 3)).alias("baseline"))


def rates(df: DataFrame, flag: str, group: str | None = None) -> DataFrame:
    """Count and rate of a flag, overall or by group; 0 for an empty table."""
    g = df.groupBy(group) if group else df.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.col(flag).cast("double")), F.lit(0.0)).alias("rate"))


def score_with(df: DataFrame, column: str, scorer: Callable[[], Callable[[list[str]], list[float]]], out: str = "loss") -> DataFrame:
    """`df` with a model's score of each text: scorer() loads the model once for each worker (D3)."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = scorer()
        for s in batches:
            yield pd.Series(model(s.tolist()), dtype="float64")

    return df.withColumn(out, run(F.col(column)))


#: What score_masks() gives for each mask.
MASK_SCORE = "original_rank int, original_prob double, male_raw double, female_raw double, neutral_raw double, total_gender_prob double, male_prob double, female_prob double, neutral_prob double, top_tokens array<string>, top_probs array<double>"


def best_of(prob: np.ndarray, tokens: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k most probable tokens, ties by the token; found by selection, only these are sorted."""
    k = min(k, prob.shape[1])
    edge = np.partition(prob, prob.shape[1] - k, axis=1)[:, prob.shape[1] - k]
    out = np.empty((len(prob), k), np.int64)
    for row, (p, e) in enumerate(zip(prob, edge)):
        at = np.flatnonzero(p >= e)
        out[row] = at[np.lexsort((tokens[at], -p[at]))][:k]
    return out


def score_masks(masks: DataFrame, scorer: Callable[[], tuple[list[str], Callable[[list[str]], np.ndarray]]], k: int = 20, report: int = 10, sentence: str = "masked_sentence", original: str = "original", block: int = 64) -> DataFrame:
    """`masks` with the columns of MASK_SCORE: a masked-word model's view of each mask, one row a mask.

    scorer() loads the model once for each worker and gives its vocabulary and a function from sentences to their
    logits at the mask (rows x vocabulary); `block` sentences are scored at once.  The vocabulary never becomes rows:
    softmax, the k best tokens, the rank and probability of the original word among them, and the probability of each gender
    among them (raw, and as shares, 0 if there is none) are taken where the logits are; the first `report` tokens
    are returned.  Words are compared without space around them and in lower case.  A null sentence gives nulls.
    """
    names = [f.split()[0] for f in MASK_SCORE.split(", ")]

    def rows(tokens: np.ndarray, plain: list[str], gender: np.ndarray, logits: np.ndarray, want: list) -> Iterator[tuple]:
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob = e / e.sum(axis=1, keepdims=True)
        best = best_of(prob, tokens, k)
        for p, at, word in zip(np.take_along_axis(prob, best, axis=1), best, want):
            raw = [float(p[gender[at] == g].sum()) for g in range(len(GENDERS))]
            total = sum(raw)
            rank = next((i for i, j in enumerate(at) if plain[j] == word), None)
            yield (None if rank is None else rank + 1, None if rank is None else float(p[rank]), *raw, total, *[x / total if total > 0 else 0.0 for x in raw], tokens[at[:report]].tolist(), p[:report].tolist())

    @F.pandas_udf(MASK_SCORE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        vocabulary, logits = scorer()
        tokens = np.array(vocabulary, dtype=object)
        plain = [t.strip().lower() for t in vocabulary]
        gender = np.array([next((g for g, name in enumerate(GENDERS) if t in CLASSES[name]), -1) for t in plain])
        for texts, words in batches:
            out = [(None,) * len(names)] * len(texts)
            there = [i for i, t in enumerate(texts) if t is not None]
            for a in range(0, len(there), block):
                at = there[a : a + block]
                want = [None if words.iloc[i] is None else words.iloc[i].strip().lower() for i in at]
                for i, row in zip(at, rows(tokens, plain, gender, np.asarray(logits([texts.iloc[i] for i in at]), np.float64), want)):
                    out[i] = row
            yield pd.DataFrame(out, columns=names).astype({"original_rank": "Int32"})

    return masks.withColumn("__s", run(F.col(sentence), F.col(original))).select(*masks.columns, "__s.*")


def pad_sizes(df: DataFrame, sizes: list[str], value: str, size: str = "size") -> DataFrame:
    """(position, size, value) for every expected size in its order, 0 where nothing was observed."""
    dim = df.sparkSession.createDataFrame([(i, s) for i, s in enumerate(sizes)], f"position int, {size} string")
    return dim.join(df.select(size, value), size, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))
