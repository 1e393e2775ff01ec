"""The addressed corpus source: addresses, columns, blocks, and runs that break and go on."""

import os

import pytest
from pyspark.sql import functions as F

from sievework.sources import addressed
from sievework.streaming import streams

SMALL = "/root/testdata/sf0.001"


def put(spark, folder, first: int, n: int, at: int) -> None:
    spark.range(first, first + n).selectExpr("id", "'t' || id AS text", "repeat('x', 50) AS rest").coalesce(1).write.mode("append").parquet(folder)
    for f in os.listdir(folder):
        if os.path.getmtime(f"{folder}/{f}") > 10**9:
            os.utime(f"{folder}/{f}", (at, at))


def test_address_columns_and_blocks(spark, tmp_path):
    for config in ("en", "fr"):
        for split in ("train", "test"):
            put(spark, f"{tmp_path}/{config}/{split}", 0 if config == "en" else 1000, 25 if split == "train" else 3, 1000)
    put(spark, f"{tmp_path}/fr/train", 2000, 10, 1001)
    got = addressed.read(spark, str(tmp_path), "fr", "train", ["id", "text"], block_rows=10)
    assert got.columns == ["id", "text", "_block", "_row"]
    rows = sorted(got.collect(), key=lambda r: r._row)
    assert [r.id for r in rows] == [*range(1000, 1025), *range(2000, 2010)]
    assert [r._row for r in rows] == list(range(35)) and all(r._block == r._row // 10 for r in rows)
    assert got.rdd.getNumPartitions() == 4
    assert addressed.read(spark, str(tmp_path), "en", "test").columns == ["id", "text", "rest", "_block", "_row"]


def test_a_file_is_an_address_too(spark):
    got = addressed.read(spark, f"file://{SMALL}", split="documents", columns=["doc_id"], block_rows=70)
    want = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())
    assert got.agg(F.max("_block")).first()[0] == (want.count() - 1) // 70


def test_wrong_addresses(spark, tmp_path):
    with pytest.raises(Exception, match="no Parquet file"):
        addressed.read(spark, str(tmp_path), "none", "train").collect()
    put(spark, f"{tmp_path}/a", 0, 3, 1000)
    with pytest.raises(Exception, match="not in"):
        addressed.read(spark, str(tmp_path), "a", columns=["id", "nothing"]).collect()


def test_row_groups_in_pieces(spark, tmp_path):
    """Blocks that begin and end inside row groups, and files without rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    os.makedirs(f"{tmp_path}/d")
    for k, n in enumerate([7, 0, 23]):
        pq.write_table(pa.table({"id": pa.array(range(k * 100, k * 100 + n), pa.int64())}), f"{tmp_path}/d/{k}.parquet", row_group_size=5)
        os.utime(f"{tmp_path}/d/{k}.parquet", (1000 + k, 1000 + k))
    rows = sorted((r._row, r.id, r._block) for r in addressed.read(spark, str(tmp_path), "d", block_rows=4).collect())
    assert rows == [(k, i, k // 4) for k, i in enumerate([*range(7), *range(200, 223)])]


def test_broken_and_restarted_runs_give_each_row_once(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(spark, src, 0, 25, 1000)

    def run():
        rows = addressed.read_stream(spark, src, columns=["id"], block_rows=10)
        return sorted((r._row, r.id, r._block) for r in streams.to_table(rows, out, "append", available_now=False).collect())

    assert run() == [(k, k, k // 10) for k in range(25)]
    put(spark, src, 25, 12, 1001)
    rows = addressed.read_stream(spark, src, columns=["id"], block_rows=10)

    def broken(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")
        raise RuntimeError("killed between writing and commit")

    with pytest.raises(Exception, match="killed"):
        rows.writeStream.foreachBatch(broken).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    put(spark, src, 37, 5, 1002)
    assert run() == [(k, k, k // 10) for k in range(42)]
    assert run() == [(k, k, k // 10) for k in range(42)]


def test_point_reads_open_their_blocks_only(spark, tmp_path):
    put(spark, f"{tmp_path}/d", 0, 95, 1000)
    put(spark, f"{tmp_path}/d", 500, 40, 1001)
    got = addressed.read_rows(spark, [94, 0, 95, 134, 94, 999], str(tmp_path), "d", columns=["id"], block_rows=10)
    assert sorted((r._row, r.id) for r in got.collect()) == [(0, 0), (94, 94), (95, 500), (134, 539)]
    assert got.rdd.getNumPartitions() == 3  # 94 and 95 share a block
    assert addressed.read_rows(spark, [], str(tmp_path), "d").count() == 0


@pytest.mark.parametrize("name", ["s_addressed", "s_point_read"])
def test_ordinals_by_id_whatever_the_files(spark, tmp_path, name):
    """Files that came in another order than their ids, and ids that are in no order within them."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from sievework.plans import catalog

    os.makedirs(f"{tmp_path}/documents.parquet")
    ids = [(k * 617) % 1000 for k in range(1000)]
    for k in range(4):
        part = ids[k * 250 : k * 250 + 250]
        pq.write_table(pa.table({"doc_id": pa.array(part, pa.int64()), "lang": [f"l{i % 7}" for i in part]}), f"{tmp_path}/documents.parquet/part-{k}.parquet", row_group_size=40)
        os.utime(f"{tmp_path}/documents.parquet/part-{k}.parquet", (2000 - k, 2000 - k))
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(catalog.ORACLES[name]).fetchall())


def test_names_with_numbers(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for k, n in enumerate(["f-c1000", "f-c101", "f-c9"]):
        pq.write_table(pa.table({"id": pa.array([k], pa.int64())}), f"{tmp_path}/{n}.parquet")
    assert [r.id for r in sorted(addressed.read(spark, f"file:{tmp_path}", order="name").collect(), key=lambda r: r._row)] == [2, 1, 0]
