"""Bounds and odd bytes: one row for each labelled id, texts that are no UTF-8."""

import pytest
from pyspark.sql import functions as F

from sievework.llm import common, decontam, entry, langid, quality, toxicity

BAD = "SELECT id AS doc_id, CAST(CASE WHEN id % 2 = 0 THEN X'66696e6520776f72647320686572650aff' ELSE X'c3a9c3a920c3286f6b' END AS STRING) AS text, 'en' AS lang, 's' AS source, 1L AS n_chars FROM range(8)"


def test_one_row_for_each_labelled_id(spark):
    """One id repeated 500 times, and ids labelled twice: the sample keeps its bound."""
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(k, f"other {k}") for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)] + [(1, 0), (2, 1), (None, 1)], "doc_id long, quality int")
    got = common.labelled_sample(docs, labels, "quality", F.lit(True), 10).collect()
    assert len(got) <= 20 and len({r.doc_id for r in got}) == len(got)
    every = common.labelled_sample(docs, labels, "quality", F.lit(True), 10**6).collect()
    assert len(every) == 39 and {r.doc_id: r.label for r in every}[1] == 1 and {r.doc_id: r.label for r in every}[2] == 1


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("bytes"))
    spark.sql(BAD).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "fine words here")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name", ["op1_quality", "op4_toxicity", "op8_sentencepiece", "op10_langid", "op3_simhash", "op7_suffix_dedup", "op9_licenses", "op11_minhash"])
def test_bytes_that_are_no_utf8(spark, folder, name):
    assert getattr(entry, name)(spark, folder).count() == 8


def test_contaminated_takes_them(spark, folder):
    assert {r.doc_id for r in entry.op6_decontamination(spark, folder).collect()} == {0, 2, 4, 6}


def test_clean_keeps_the_bytes(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = decontam.clean(docs, spark.createDataFrame([(1, "nothing of this")], "item_id long, text string"))
    assert {r.h for r in kept.select(F.hex("text").alias("h")).collect()} == {r.h for r in docs.select(F.hex("text").alias("h")).collect()}
    assert langid and quality and toxicity


def test_runs_of_a_block_are_those_of_its_texts():
    """Texts hashed at once give each text's own runs and keys: none crosses from one text to the next."""
    import random

    import numpy as np
    import pyarrow as pa

    from sievework.llm import suffix

    rnd = random.Random(3)
    texts = [bytes(rnd.choices(b"ab", k=n)) for n in (40, 41, 700, 90, 3000, 40)] + [b"a" * 400, b"\xff" * 55]
    texts += texts[:3]
    got, keys = [], []
    for at, t, off, size in suffix.blocks(pa.array(texts), 40):
        data = np.frombuffer(t, np.uint8)
        first, n, key, _ = suffix.block_runs(data, off, size, 40, 16)
        owner = np.searchsorted(off, first, "right") - 1
        got += zip((at + owner).tolist(), (first - off[owner]).tolist(), n.tolist(), key.tolist())
        keys += suffix.run_keys(data, off, size, 40, 16).tolist()
    want = [(i, *r) for i, t in enumerate(texts) for r in zip(*(x.tolist() for x in suffix.runs(np.frombuffer(t, np.uint8), 40, 16)))]
    assert got == want and len(keys) > len(want)  # the gram of some keys stands twice in its run
    alone = [k for t in texts for k in suffix.run_keys(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]), 40, 16).tolist()]
    assert sorted(keys) == sorted(alone)
