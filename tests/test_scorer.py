"""The masked-word scorer at the size of a real vocabulary, against the plan that makes a row of each candidate."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import bias
from sievework.schemas import FIRST_NATIVE

WORDS = ["he", "She", " they ", "his", "her", "them", "him", "their"]


def model(size: int):
    def load():
        tokens = [*WORDS, *(f"w{k}" for k in range(size - len(WORDS)))]

        def logits(texts):
            out = np.stack([np.random.default_rng(int(hashlib.md5(t.encode()).hexdigest()[:8], 16)).integers(0, 12, size) / 2.0 for t in texts])
            out[:, : len(WORDS)] += 4
            return out

        return tokens, logits

    return load


@pytest.mark.parametrize("size,k", [(FIRST_NATIVE, 20), (12, 20), (200, 3)])
def test_same_as_a_row_for_each_candidate(spark, size, k):
    sentences = spark.createDataFrame([(i, f"s{i}: he said that they saw her") for i in range(6)], "id int, sentence string")
    masks = bias.masked_rows(sentences, ["id"])
    got = {(r.id, r.pos): r for r in bias.score_masks(masks, model(size), k=k, block=4).collect()}
    assert len(got) == 18
    tokens, logits = model(size)()
    rows = []
    for r in masks.collect():
        e = np.exp(logits([r.masked_sentence])[0])
        order = np.lexsort((np.array(tokens, dtype=object), -e))[: k + 30]
        rows += [(r.id, r.pos, r.original, tokens[j], float(e[j] / e.sum())) for j in order]
    top = bias.top_k(spark.createDataFrame(rows, "id int, pos int, original string, token string, prob double"), ["id", "pos"], k)
    mass = {(r.id, r.pos): r for r in bias.gender_mass(top.withColumn("token", F.trim("token")), ["id", "pos"]).collect()}
    want: dict = {}
    for r in top.collect():
        want.setdefault((r.id, r.pos), []).append((r["rank"], r.token, r.prob, r.original))
    for key, mine in got.items():
        best = sorted(want[key])
        assert mine.top_tokens == [b[1] for b in best][:10]
        assert mine.top_probs == pytest.approx([b[2] for b in best][:10])
        hit = [b for b in best if b[1].strip().lower() == b[3]]
        assert mine.original_rank == (hit[0][0] if hit else None) and (mine.original_prob is None) == (not hit)
        for g in ("male", "female", "neutral"):
            assert mine[f"{g}_raw"] == pytest.approx(mass[key][f"{g}_raw"]) and mine[f"{g}_prob"] == pytest.approx(mass[key][f"{g}_prob"])
    means = bias.weighted_gender(bias.score_masks(masks, model(size), k=k), ["id"]).collect()
    assert len(means) == 6


def test_odd_rows(spark):
    df = spark.createDataFrame([("a [MASK]", None, 1), (None, "he", 2), ("", "HE ", 3)], "masked_sentence string, original string, male_mean int")
    got = {r.male_mean: r for r in bias.score_masks(df, model(30), k=30).collect()}
    assert got[2].top_tokens is None and got[2].total_gender_prob is None
    assert got[1].original_rank is None and got[1].total_gender_prob > 0
    assert got[3].original_rank is not None
    assert bias.score_masks(df.limit(0), model(30)).count() == 0


@pytest.mark.parametrize("k", [2, 8, 30])
def test_best_of_arrays_as_a_row_for_each_candidate(spark, k):
    words = ["he", "she", "x", "they", "his", "her"]
    rows = [(i, [((i * 7 + j * j) % 4) / 8.0 for j in range(len(words))]) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, prob array<double>").withColumn("token", F.array(*map(F.lit, words)))
    flat = df.select("id", F.explode(F.arrays_zip("token", "prob")).alias("z")).select("id", "z.token", "z.prob")
    top = bias.top_k(flat, ["id"], k)
    want: dict = {}
    for r in top.orderBy("id", "rank").collect():
        want.setdefault(r.id, []).append((r.token, r.prob))
    masks = df.select("id", bias.best(F.col("token"), F.col("prob"), k).alias("best"))
    assert {r.id: [(x.token, x.prob) for x in r.best] for r in masks.collect()} == want
    mass = {r.id: r for r in bias.gender_mass(top, ["id"]).collect()}
    for r in bias.best_mass(masks).collect():
        assert r.male_prob == pytest.approx(mass[r.id].male_prob) and r.total_gender_prob == pytest.approx(mass[r.id].total_gender_prob)


@pytest.mark.parametrize("name,exchanges", [("b_topk_rank", 0), ("b_encoder_pipeline", 1)])
def test_masks_are_ranked_without_a_sort(spark, name, exchanges):
    from sievework.plans import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and plan.count("Exchange") == exchanges
