"""What the operators of this folder share: table access, shared-folder checkpoints, fold tests."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.session import made

#: Stands for a null id in join keys; ids themselves are passed through unchanged.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only in local mode (tests), elsewhere it must be set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sievework-ckpt-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Written as a table in the shared checkpoint folder and read again: no lineage to recompute.  See session.release()."""
    path = made(f"{ensure_checkpoint_dir(df.sparkSession)}/sievework-{what}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy() -> None:
    """Gives freed memory back to the system, as a reused Python worker would keep it from task to task."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal text modulo k (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(k)


def _labelled(labels: DataFrame, label: str, allowed: Column) -> DataFrame:
    return (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & allowed)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )


def class_counts(labels: DataFrame, label: str, allowed: Column) -> dict[int, int]:
    """Labelled ids of each label among the allowed ones."""
    return {0: 0, 1: 0} | {r.label: r.n for r in _labelled(labels, label, allowed).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int) -> DataFrame:
    """Text and label (0/1) of at most 2 * per_class labelled rows, per_class of each label at most.

    The rows are those with the smallest hash of their id, so the choice does not depend on the
    partitioning.  Rows with a null id or label take no part; of an id labelled twice the larger
    label counts, and of an id that several rows of `docs` have the row with the smallest text hash.  The bound makes
    the id list safe to broadcast; only the texts of chosen ids are shuffled.
    """
    ok = _labelled(labels, label, allowed)
    halves = [
        ok.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)
    ]
    chosen = halves[0].unionByName(halves[1])
    rows = chosen.collect()  # at most 2 * per_class pairs
    spark = docs.sparkSession
    small = spark.createDataFrame([(r.doc_id, r.label) for r in rows], "doc_id long, label int")
    found = docs.select("doc_id", F.make_valid_utf8("text").alias("text")).join(F.broadcast(small), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")).select("doc_id", "text", "label")


def text_slices(column, most: int) -> Iterator[tuple[int, int]]:
    """(offset, rows) of slices of an Arrow string or binary column that hold about `most` bytes (one text at least)."""
    import pyarrow.compute as pc

    start = size = 0
    for k, n in enumerate(pc.binary_length(column).to_pylist()):
        size += n or 0
        if size >= most:
            yield start, k + 1 - start
            start, size = k + 1, 0
    if start < len(column):
        yield start, len(column) - start


def _packed(docs: DataFrame, keep: list[str], text: Column) -> DataFrame:
    """All kept columns as one struct (so that no name can clash) beside the text.

    A struct needs a field: a constant stands in where nothing is kept.
    """
    fields = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)] or [F.lit(0).alias("none")]
    return docs.select(F.struct(*fields).alias("kept"), text.alias("text"))


def _unpacked(keep: list[str]) -> list[Column]:
    return [F.col("kept").getField(f"c{k}").alias(c) for k, c in enumerate(keep)]


def add_columns(docs: DataFrame, keep: list[str], fields: str, make: Callable[[], Callable[[list], list]], text: str = "text", binary: bool = False, block_bytes: int = 1_000_000) -> DataFrame:
    """The columns `keep` unchanged and new ones computed from whole texts, block by block.

    make() runs once for each task and gives a function from a list of texts (null: empty) to one list or
    array for each new column.  Kept columns pass through as Arrow arrays, so nulls and large integers
    stay exact; a new column takes the place of a kept one of its name.  No shuffle; rows keep their
    number.  A block holds about block_bytes bytes of text, or one text.  Bytes that are no UTF-8 come as replacement
    characters, unless `binary` asks for the bytes.
    """
    new = T.StructType.fromDDL(fields)
    names = {f.name for f in new.fields}
    keep = [c for c in keep if c not in names]
    src = _packed(docs, keep, F.col(f"`{text}`").cast("binary") if binary else F.make_valid_utf8(F.col(f"`{text}`").cast("string")))
    made = T.StructType([T.StructField(f"n{k}", f.dataType) for k, f in enumerate(new.fields)])
    out = T.StructType([src.schema["kept"], T.StructField("made", made)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        work, empty = make(), b"" if binary else ""
        kinds = [to_arrow_type(f.dataType) for f in made.fields]
        try:
            for b in batches:
                for at, n in text_slices(b.column(1), block_bytes):
                    part = b.slice(at, n)
                    got = work([empty if t is None else t for t in part.column(1).to_pylist()])
                    columns = [pa.array(x, kind) for x, kind in zip(got, kinds)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.StructArray.from_arrays(columns, names=made.names)], names=["kept", "made"])
        finally:
            del work
            tidy()

    return src.mapInArrow(run, out).select(*_unpacked(keep), *[F.col("made").getField(f"n{k}").alias(f.name) for k, f in enumerate(new.fields)])


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[list], list]], text: str = "text", block_bytes: int = 1_000_000) -> DataFrame:
    """The rows, all columns, for whose text the function that make() gives says True (null text: None).

    Bytes that are no UTF-8 come as replacement characters; the rows themselves stay as they are.
    """
    src = _packed(docs, docs.columns, F.make_valid_utf8(F.col(f"`{text}`").cast("string")))

    def run(batches):
        import pyarrow as pa

        work = make()
        try:
            for b in batches:
                for at, n in text_slices(b.column(1), block_bytes):
                    part = b.slice(at, n)
                    yield part.filter(pa.array(work(part.column(1).to_pylist()), pa.bool_())).select(["kept"])
        finally:
            del work
            tidy()

    return src.mapInArrow(run, T.StructType([src.schema["kept"]])).select(*_unpacked(docs.columns))
