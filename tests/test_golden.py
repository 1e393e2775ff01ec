"""Small cases worked out by hand, and invariants."""

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as fx
from sievework.functions.text import draw
from sievework.operators import bias, relational, sampling, stats, tokens
from sievework.operators.tokens import ChunkRule


def lengths(spark, n, backfill, zeroth=False, key="k"):
    df = spark.createDataFrame([(key, n)], "id string, n bigint")
    rule = ChunkRule(10, 4, 2, backfill, zeroth)
    got = [r.len for r in tokens.chunk_spans(df, rule, "id").orderBy("chunk_no").collect()]
    p = tokens.plan_chunks(df, rule, "id").first()
    assert sum(got) + p.skipped == n
    return got, p.skipped, p.borrowed


@pytest.mark.parametrize(
    ("n", "backfill", "zeroth", "want", "skipped"),
    [(0, True, False, [], 0), (1, True, False, [1], 0), (1, True, True, [], 1), (3, False, True, [3], 0), (8, True, False, [8], 0), (9, True, False, [8], 1), (11, False, False, [8], 3), (12, True, False, [8, 4], 0)],
)
def test_chunks(spark, n, backfill, zeroth, want, skipped):
    assert lengths(spark, n, backfill, zeroth)[:2] == (want, skipped)


def test_backfill_borrows(spark):
    for key in ("a", "b", "c"):
        got, skipped, r = lengths(spark, 11, True, key=key)
        assert (got, skipped) == ([8 - r, 3 + r], 0) and 0 <= r < 5
        got, _, r = lengths(spark, 19, True, key=key)
        assert got == [8, 8 - r, 3 + r]


def test_framed_chunks_hold_all_tokens(spark):
    rows = [(f"d{n}", list(range(n))) for n in range(0, 60)]
    df = spark.createDataFrame(rows, "id string, input_ids array<bigint>")
    for r in tokens.chunk(df, ChunkRule(10, 4, 2, True), "id").collect():
        assert (r.input_ids[0], r.input_ids[-1]) == (50281, 50282) and len(r.input_ids) == r.len <= 10


def test_budgets(spark):
    df = spark.createDataFrame([(f"r{i}", n) for i, n in enumerate([5, 4, 3, 2])], "id string, n bigint")
    order = {r.id: r.rn for r in sampling.permute(df, "id", 1).collect()}
    n = [x for _, x in sorted((order[f"r{i}"], x) for i, x in enumerate([5, 4, 3, 2]))]
    cum = [sum(n[: k + 1]) for k in range(4)]
    assert sorted(r.cum for r in sampling.stop_after(df, "id", "n", 8, 1).collect()) == [c for c, x in zip(cum, n) if c - x < 8]
    assert sorted(r.cum for r in sampling.stop_before(df, "id", "n", 8, 1).collect()) == [c for c in cum if c <= 8]


def test_resampling_reaches_its_target(spark):
    f = spark.createDataFrame([(f"f{i}", n) for i, n in enumerate([5, 4, 3, 2])], "folder string, tokens bigint")
    got = sampling.resample_folders(f, 20, 1).collect()
    total = sum(r.tokens for r in got)
    assert {r.folder for r in got if r.copy_id == 0} == {"f0", "f1", "f2", "f3"} and 20 <= total < 25
    with pytest.raises(ValueError):
        sampling.resample_folders(f.withColumn("tokens", F.lit(0).cast("bigint")), 20, 1)


def test_mixture_and_audit(spark):
    w = spark.createDataFrame([("a", 50.0), ("b", 30.0), ("c", 20.0)], "domain string, pct double")
    assert {r.domain: (r.pct, r.budget) for r in sampling.mixture_budget(w, 1000, ["c"]).collect()} == {"a": (62.5, 625), "b": (37.5, 375)}
    n = lambda *rows: spark.createDataFrame(list(rows), "dataset string, n bigint")
    got = {r.dataset: (r.ratio_ok, r.total_ok, r.train_n) for r in stats.audit_split(n(("x", 1000), ("y", 1000), ("z", 5)), n(("x", 999), ("y", 990)), n(("x", 1), ("y", 9))).collect()}
    assert got == {"x": (True, True, 999), "y": (False, False, 990), "z": (False, False, 0)}


@pytest.mark.parametrize(
    ("said", "a", "b", "want"),
    [("help filing her taxes.", "female", "male", "help filing his taxes."), ("that he could pay", "male", "female", "that she could pay"), ("We saw her.", "female", "male", "We saw his."), ("He was late.", "male", "neutral", "They were late."), ("the there", "male", "neutral", "the there")],
)
def test_rewrite(spark, said, a, b, want):
    df = spark.createDataFrame([(said,)], "s string")
    assert df.select(fx.rewrite(F.col("s"), a, b)).first()[0] == want


def test_mask_and_ties(spark):
    r = bias.masked_rows(spark.createDataFrame([(1, "I met him.")], "id int, sentence string"), ["id"]).collect()
    assert [(x.pos, x.original, x.gender, x.masked_sentence) for x in r] == [(2, "him", "male", "I met [MASK].")]
    zero = {g: F.lit(0.0) for g in fx.GENDERS}
    row = spark.range(1).select(bias.preferred(zero).alias("a"), bias.preferred({"male": F.lit(2.0), "female": F.lit(2.0), "neutral": F.lit(3.0)}, largest=False).alias("b")).first()
    assert (row.a, row.b) == ("male", "male")
    g = spark.createDataFrame([("m",), ("m",), ("f",), ("n",)], "g string")
    assert bias.baseline(g, "g").first().baseline == 0.375
    assert abs(bias.baseline(g.limit(0), "g").first().baseline - 1 / 3) < 1e-12


def test_ordinal_does_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("k", draw(F.col("id")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append([r.id for r in sampling.ordinal(df, [F.asc("k"), F.asc("id")]).orderBy("rn").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == [r.id for r in df.orderBy("k", "id").collect()]


def test_range_and_asof(spark):
    p = spark.createDataFrame([(x,) for x in (0, 5, 99, 100)], "x bigint")
    r = spark.createDataFrame([("a", 0, 5), ("b", 5, 100), ("c", 7, 7)], "name string, lo bigint, hi bigint")
    assert sorted((q.x, q.name) for q in relational.range_join(p, r, "x", "lo", "hi", 8).collect()) == [(0, "a"), (5, "b"), (99, "b")]
    left = spark.createDataFrame([("k", 5), ("k", 1), ("j", 9)], "k string, t bigint")
    right = spark.createDataFrame([("k", 2, 20), ("k", 5, 50)], "k string, t bigint, v bigint")
    assert sorted((q.k, q.t, q.v or 0) for q in relational.asof_join(left, right, "k", "t", "v", "v").collect()) == [("j", 9, 0), ("k", 1, 0), ("k", 5, 50)]


def test_native_plans_hold_no_python(spark):
    df = spark.createDataFrame([("a", "x y z")], "doc_id string, text string")
    plan = tokens.encode(df, tokens.vocabulary(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_cosine_search_takes_every_hundredth_row(spark):
    from sievework.plans import catalog

    out = catalog.QUERIES["r_cosine_topk_all"](spark, "/root/testdata/sf0.01").groupBy("query_id").count().collect()
    ids = [r.vec_id for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id % 100 = 0").collect()]
    assert sorted(r.query_id for r in out) == sorted(ids) and {r["count"] for r in out} == {5}


def test_softmax_takes_whole_vectors(spark):
    import math

    from sievework.plans import catalog

    path = "/root/testdata/sf0.001"
    got = {r.vec_id: r.top for r in catalog.QUERIES["f_softmax_whole"](spark, path).collect()}
    for r in spark.read.parquet(f"{path}/embeddings.parquet").collect():
        e = [math.exp(x - max(r.embedding)) for x in r.embedding]
        assert abs(got[r.vec_id] - max(e) / sum(e)) < 1e-6
