"""Sources, sinks, streams and small functions on files of their own, and the ordinal on rows with a payload."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from sievework.operators import bias, retrieval, sampling, stats, tokens
from sievework.operators.tokens import ChunkRule
from sievework.schemas import FIRST_NATIVE, MASK_ID
from sievework.sources import files
from sievework.streaming import streams


def test_ordinal_keeps_and_numbers_rows_with_a_payload(spark):
    rows = spark.range(0, 1_000_000, 1, 8).select(((F.col("id") * 7_919) % 1_000_000).alias("k"), F.md5(F.col("id").cast("string").cast("binary")).alias("payload"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("id"))
    o = [F.asc("k")]
    got = sampling.ordinal(rows, o).agg(F.count("*").alias("n"), F.sum((F.col("rn") != F.col("k") + 1).cast("int")).alias("wrong")).first()
    assert (got.n, got.wrong) == (1_000_000, 0)
    assert sorted(r.k for r in files.line_range(rows, o, 500_000, 500_100).select("k").collect()) == list(range(500_000, 500_100))
    shards = files.assign_shards(rows, o, 1000).groupBy("folder").count().agg(F.count("*").alias("n"), F.min("count").alias("a"), F.max("count").alias("b")).first()
    assert (shards.n, shards.a, shards.b) == (1000, 1000, 1000)
    ids = files.fallback_id(rows.withColumn("was", F.col("id")), o)
    assert ids.where(F.col("was").isNull() & (F.col("id") != F.col("k").cast("string"))).count() == 0


def test_gzip_lines_and_quarantine(spark, tmp_path):
    for name, lines in (("a.json.gz", ['{"id": "1", "text": "x"}', "{broken", '{"id": "2", "text": null}']), ("b.txt.gz", ['{"id": "3", "text": "y"}'])):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write("\n".join(lines))
    rows = files.read_jsonl(spark, str(tmp_path), pattern="*.json.gz", splits=3)
    assert rows.rdd.getNumPartitions() == 3
    good, bad = files.quarantined(rows.cache())
    assert sorted((r.id, r.text) for r in good.collect()) == [("1", "x"), ("2", None)] and [r[0] for r in bad.collect()] == ["{broken"]
    assert files.count_lines(spark, str(tmp_path / "a.json.gz")) == 3


def test_trees_names_and_reports(spark, tmp_path):
    root = str(tmp_path / "tree")
    for path in ("one/web", "two/web", "two/books"):
        files.write_records(spark.range(4).coalesce(1), f"{root}/{path}", rows_per_file=3, compression="none")
    tree = files.read_tree(spark, root)
    assert len({r[0] for r in tree.select("_file").collect()}) == 6
    assert {r.domain for r in files.domain_of(tree).collect()} == {"web", "books"}
    assert {(r.dataset, r.folder) for r in files.split_names(tree).collect()} == {("one", "one_web"), ("two", "two_web"), ("two", "books")}
    files.export_csv(spark.createDataFrame([(1, "a,b"), (2, None)], "n int, s string"), f"{tmp_path}/csv")
    assert sorted(spark.read.option("header", "true").csv(f"{tmp_path}/csv").collect()) == [("1", "a,b"), ("2", None)]
    files.export_json(spark.createDataFrame([(1, [1, 2])], "n int, xs array<int>"), f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").first().xs == [1, 2]
    (tmp_path / "w.tsv").write_text("sentid\tsentence\tpronoun\toccupation\tparticipant\tgender\ttarget\n1\tHe paid.\the\tclerk\tguest\tmale\t0\n")
    assert [(r.sentid, r.sentence, r.target) for r in files.read_examples(spark, f"{tmp_path}/w.tsv").collect()] == [("1", "He paid.", "0")]
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        spark.conf.set("spark.sql.ansi.enabled", "true")
        files.narrow(spark.createDataFrame([([2**40],)], "a array<long>"), ["a"], {"a": "array<int>"}).collect()
    assert files.narrow(spark.createDataFrame([([7],)], "a array<long>"), ["a"], {"a": "array<int>"}).first().a == [7]


def test_folder_statistics_from_disk_into_a_sample(spark, tmp_path):
    chunks = spark.createDataFrame([("f1", 10), ("f1", 30), ("f2", 5)], "folder string, len long")
    got = stats.folder_stats(chunks, spark.createDataFrame([("f1", 2), ("f3", 4)], "folder string, skipped long"))
    rows = {r.folder: (r.total_tokens_written, r.total_tokens_skipped) for r in got.collect()}
    assert rows == {"f1": (40, 2), "f2": (5, 0), "f3": (0, 4)}
    for f, (n, _) in rows.items():
        (tmp_path / f).mkdir()
        (tmp_path / f / "stats.json").write_text(json.dumps({"folder": f, "total_tokens_written": n}, indent=1))
        (tmp_path / f / "other.json").write_text("{}")
    found = files.read_folder_stats(spark, str(tmp_path), "folder string, total_tokens_written long")
    assert {r.folder for r in found.collect()} == {"f1", "f2", "f3"}
    sample = sampling.sample_folders(found.where("total_tokens_written > 0"), 45, 1, "folder", "total_tokens_written").agg(F.sum("total_tokens_written")).first()[0]
    assert sample == 45


def test_streams_resume_with_new_files_and_batches(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    seen = []
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(src)
        stream = streams.file_stream(spark, src, "id long", files_per_trigger=1)
        streams.ingest(stream, out, state)
        streams.each_batch(stream, f"{state}-each", lambda df, n: seen.append((n, df.count())))
        assert spark.read.parquet(out).count() == 10 * (k + 1)
    assert seen == [(0, 10), (1, 10), (2, 10)]


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    for k, batch in enumerate(([("a", "2024-01-01 10:00:00")], [("b", "2024-01-02 10:00:00")], [("c", "2024-01-03 10:00:00")], [("late", "2024-01-01 09:00:00")], [("d", "2024-01-04 10:00:00")])):
        spark.createDataFrame(batch, "k string, t string").selectExpr("k", "cast(t as timestamp) ts").coalesce(1).write.mode("append").parquet(src)
        for f in (f"{src}/{x}" for x in os.listdir(src)):  # files are taken in the order of their times
            if os.path.getmtime(f) > 10**9:
                os.utime(f, (1000 + k, 1000 + k))
    e = streams.file_stream(spark, src, "k string, ts timestamp", 1)
    got = streams.to_table(streams.tumbling(e, "ts", "1 hour", "1 hour", F.count("*").alias("n")), str(tmp_path / "t"), "append")
    starts = [r.t for r in got.select(F.date_format("window.start", "dd HH").alias("t")).collect()]
    assert "01 09" not in starts and {"01 10", "02 10"} <= set(starts), starts  # a batch is held against the watermark of the batch before


def test_scorer_and_tokenizer_plugs(spark):
    df = spark.createDataFrame([(1, "a bb"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.input_ids for r in tokens.encode_with(df, lambda texts: [[len(w) for w in t.split()] for t in texts]).collect()}
    assert got == {1: [1, 2], 2: []}
    scored = bias.score_with(df.fillna(""), "text", lambda: lambda texts: [float(len(t)) for t in texts])
    assert {r.doc_id: r.loss for r in scored.collect()} == {1: 4.0, 2: 0.0}
    assert [round(r.pct) for r in stats.renormalise(spark.createDataFrame([(1.0,), (3.0,)], "v double"), "v", "pct").collect()] == [25, 75]


def test_encode_with_a_tail_beyond_the_head(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a a a b b c d"), (2, "d c a"), (3, "")], "doc_id long, text string")
    v = tokens.vocabulary(docs)
    whole = {r.doc_id: list(r.input_ids) for r in tokens.encode(docs, v).collect()}
    monkeypatch.setattr(tokens, "HEAD", 2)
    ids = tokens.encode(docs, v)
    assert {r.doc_id: list(r.input_ids) for r in ids.collect()} == whole == {1: [FIRST_NATIVE + x for x in (0, 0, 0, 1, 1, 2, 3)], 2: [FIRST_NATIVE + x for x in (3, 2, 0)]}
    assert {r.doc_id: r.text for r in tokens.decode(ids, v).collect()} == {1: "a a a b b c d", 2: "d c a"}


def test_masks_frames_and_warm_up(spark):
    df = spark.createDataFrame([(1, list(range(1, 2001)))], "k long, ids array<long>")
    out = df.select(tokens.mask_ids(F.col("ids"), F.col("k"), 0.3).alias("m")).first().m
    assert 500 < out.count(MASK_ID) < 700 and all(a == b or a == MASK_ID for a, b in zip(out, range(1, 2001)))
    with pytest.raises(Exception, match="not framed"):
        tokens.checked_frames(df.select("k", F.col("ids").alias("input_ids")), ChunkRule(128)).collect()
    got = spark.createDataFrame([(0,), (500,), (2000,)], "n long").select(tokens.warm_up_batch(F.col("n"), 1000, 8, 64).alias("b")).collect()
    assert [r.b for r in got] == [8, 32, 64]


def test_softmax_of_many_candidates(spark):
    df = spark.range(5000).groupBy().agg(F.transform(F.array_sort(F.collect_list("id")), lambda x: x / 1000.0).alias("l"))
    p = df.select(bias.softmax(F.col("l")).alias("p")).first().p
    assert abs(sum(p) - 1) < 1e-9 and abs(p[-1] / p[0] - 2.718281828459045**4.999) < 1e-6


def test_last_token_of_a_masked_row(spark):
    df = spark.createDataFrame([([[1.0], [2.0], [3.0]], [1, 1, 0]), ([[1.0]], [0])], "v array<array<double>>, m array<int>")
    assert [r[0] for r in df.select(retrieval.last_token(F.col("v"), F.col("m"))).collect()] == [[2.0], None]


def test_rewrite_shards(spark, tmp_path):
    src = f"{tmp_path}/in"
    df = spark.createDataFrame([(k, [k, 2 * k], f"t{k}", "ab"[k % 2]) for k in range(40)], "id long, input_ids array<long>, text string, folder string")
    df.write.partitionBy("folder").parquet(src)
    files.rewrite_shards(spark, src, f"{tmp_path}/out", ["id", "input_ids", "folder"], {"input_ids": "array<smallint>", "id": "int"})
    out = spark.read.parquet(f"{tmp_path}/out")
    assert dict(out.dtypes) == {"id": "int", "input_ids": "array<smallint>", "folder": "string"} and out.count() == 40
    assert sorted((r.id, list(r.input_ids), r.folder) for r in out.collect()) == [(k, [k, 2 * k], "ab"[k % 2]) for k in range(40)]
    import glob

    import pyarrow.parquet as pq

    assert {pq.read_metadata(f).row_group(0).column(0).compression for f in glob.glob(f"{tmp_path}/out/folder=a/*.parquet")} == {"UNCOMPRESSED"}
    spark.createDataFrame([(1, [70_000])], "id long, input_ids array<long>").write.parquet(f"{tmp_path}/big")
    with pytest.raises(Exception, match="does not fit"):
        files.rewrite_shards(spark, f"{tmp_path}/big", f"{tmp_path}/never", casts={"input_ids": "array<smallint>"})
    assert not glob.glob(f"{tmp_path}/never/*.parquet")
    with pytest.raises(ValueError, match="not in"):
        files.rewrite_shards(spark, src, f"{tmp_path}/no", ["nothing"])


def test_failed_folders_are_listed(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/good")
    got = {r.folder: (r.ok, r.error) for r in files.each_folder(spark, ["good", "none"], lambda f: spark.read.parquet(f"{tmp_path}/{f}").write.parquet(f"{tmp_path}/copy-{f}")).collect()}
    assert got["good"] == (True, None) and got["none"][0] is False and "PATH_NOT_FOUND" in got["none"][1]
    assert spark.read.parquet(f"{tmp_path}/copy-good").count() == 3


def test_shard_ids_by_content(spark):
    df = spark.createDataFrame([(0, 0, "a"), (0, 1, "a"), (1, 0, "b"), (1, 1, None)], "shard int, place int, text string")
    assert [r.id for r in files.shard_ids(df, "shard", "place", 10).orderBy("shard", "place").collect()] == ["0", "1", "10", "11"]
    assert len({r.id for r in files.shard_ids(df, "shard", "place", 10, "text").collect()}) == 4


def test_intermediate_tables_are_released(spark):
    import os

    from sievework import session

    session.release(spark)
    df = session.stored(spark.range(5), "some")
    folders = list(session._MADE)
    assert df.count() == 5 and len(folders) == 1 and os.path.isdir(folders[0])
    assert session.release(spark) == 1 and not os.path.exists(folders[0]) and session.release(spark) == 0
