"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.schemas import TEXT, WINOGENDER


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str = TEXT, pattern: str | None = None, splits: int | None = None) -> DataFrame:
    """JSON lines, gzipped or plain (S3, S4, S23): lines that do not parse go to _corrupt_record.

    A gzip file is one task; `splits` spreads its rows afterwards.
    """
    reader = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    out = reader.json(path)
    return out.repartition(splits) if splits else out


def line_range(rows: DataFrame, order: list, start: int, end: int) -> DataFrame:
    """Rows whose ordinal (from 0) lies in [start, end)."""
    from sievework.operators.sampling import ordinal

    return ordinal(rows, order, "__rn").where((F.col("__rn") > start) & (F.col("__rn") <= end)).drop("__rn")


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def fallback_id(rows: DataFrame, order: list, column: str = "id") -> DataFrame:
    """The id as a string; a missing one becomes the row's ordinal from 0."""
    from sievework.operators.sampling import ordinal

    return ordinal(rows, order, "__rn").withColumn(column, F.coalesce(F.col(column).cast("string"), (F.col("__rn") - 1).cast("string"))).drop("__rn")


def assign_shards(rows: DataFrame, order: list, shard_rows: int, out: str = "folder") -> DataFrame:
    """The number of the shard of `shard_rows` rows that each row falls in."""
    from sievework.operators.sampling import ordinal

    return ordinal(rows, order, "__rn").withColumn(out, F.floor((F.col("__rn") - 1) / shard_rows).cast("bigint")).drop("__rn")


def write_records(df: DataFrame, path: str, by: list[str] | None = None, rows_per_file: int | None = None, compression: str = "zstd", overwrite: bool = False) -> None:
    """Columnar records (S9, S12, S20): partition columns take the place of folders that would be moved."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression)
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*by) if by else w).parquet(path)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """All records under a root at any depth, with the file each came from."""
    return spark.read.option("recursiveFileLookup", "true").parquet(root).withColumn("_file", F.col("_metadata.file_path"))


def domain_of(df: DataFrame, column: str = "_file") -> DataFrame:
    """The name of the folder that holds each record's file."""
    return df.withColumn("domain", F.try_element_at(F.split(column, "/"), F.lit(-2)))


def split_names(df: DataFrame, column: str = "_file") -> DataFrame:
    """`df` with folder (the one that holds the file) and dataset (the one above); a folder whose name comes in
    several datasets gets its dataset as a prefix (S18, S19).

    The table of folders, one row for each, is what is aggregated and joined back.
    """
    parts = F.split(column, "/")
    named = df.withColumn("folder", F.try_element_at(parts, F.lit(-2))).withColumn("dataset", F.try_element_at(parts, F.lit(-3)))
    twice = named.groupBy("folder").agg(F.count_distinct("dataset").alias("__d")).where("__d > 1")
    return named.join(twice, "folder", "left").withColumn("folder", F.when(F.col("__d").isNotNull(), F.concat_ws("_", "dataset", "folder")).otherwise(F.col("folder"))).drop("__d")


def quarantined(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that did not parse, of read_jsonl()."""
    bad = F.col("_corrupt_record")
    return rows.where(bad.isNull()).drop("_corrupt_record"), rows.where(bad.isNotNull()).select("_corrupt_record")


def resume_from(rows: DataFrame, order: list, done: int) -> DataFrame:
    """Rows after the first `done` in `order`, where a broken run goes on."""
    from sievework.operators.sampling import ordinal

    return ordinal(rows, order, "__rn").where(F.col("__rn") > done).drop("__rn")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """The example sentences of bias evaluation from CSV or TSV files with a header, null where a field is empty."""
    kind = "\t" if path.endswith("tsv") else ","
    return spark.read.schema(WINOGENDER).option("header", "true").option("sep", kind).csv(path)


def export_json(report: DataFrame, path: str) -> None:
    """A report as one JSON-lines file."""
    report.coalesce(1).write.json(path)


def export_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A report as one CSV file with a header."""
    df.coalesce(1).write.option("header", "true").csv(path)


def narrow(df: DataFrame, keep: list[str], casts: dict[str, str]) -> DataFrame:
    """Projection with checked narrowing: a value that does not fit raises an error under ANSI mode."""
    return df.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in keep])


def rewrite_shards(spark: SparkSession, source: str, target: str, keep: list[str] | None = None, casts: dict[str, str] | None = None, compression: str = "none") -> None:
    """The shards of a tree written anew: some columns, narrower types and another compression, folder by folder.

    Folders stay as they are (`name=value` folders as partition columns); a value that does not fit its new type ends the rewrite with an error
    before the target is committed, never with a changed value.  `keep` must name columns that are there.
    """
    rows = spark.read.parquet(source)
    missing = set(keep or []) - set(rows.columns)
    if missing:
        raise ValueError(f"{sorted(missing)} not in {rows.columns}")
    keep = keep or rows.columns
    folders = [p for p in partition_columns(rows) if p in keep]
    checked = {c: F.when(F.col(c).isNull() | _fits(F.col(c), rows.schema[c].dataType.simpleString(), k), F.col(c).cast(k)).otherwise(F.raise_error(F.lit(f"a value of {c} does not fit {k}"))) for c, k in (casts or {}).items() if c in keep}
    write_records(rows.select(*[checked[c].alias(c) if c in checked else F.col(c) for c in keep]), target, by=folders or None, compression=compression)


def partition_columns(rows: DataFrame) -> list[str]:
    """The columns of a file table whose values come from its folders' names."""
    some = rows.select(F.input_file_name().alias("f")).limit(1).collect()
    return [part.split("=", 1)[0] for part in some[0].f.split("/")[:-1] if "=" in part and part.split("=", 1)[0] in rows.columns] if some else []


def _fits(value, was: str, kind: str):
    """Whether a value, or each element of an array, is the same after a cast there and back."""
    if was.startswith("array<"):
        element = kind.removeprefix("array<").removesuffix(">")
        return F.forall(value, lambda x: x.isNull() | x.try_cast(element).cast(was.removeprefix("array<").removesuffix(">")).eqNullSafe(x))
    return value.try_cast(kind).cast(was).eqNullSafe(value)


def shard_ids(rows: DataFrame, shard: str, place: str, shard_rows: int = 30_000, text: str | None = None) -> DataFrame:
    """`rows` with id: shard * shard_rows + place in the shard, or a hash of the text and the place where `text` is named.

    The hash does not change when rows are read in other shards, except for rows of one text.
    """
    number = F.col(shard).cast("bigint") * shard_rows + F.col(place).cast("bigint")
    return rows.withColumn("id", number.cast("string") if text is None else F.md5(F.concat_ws(" ", F.coalesce(text, F.lit("")), number.cast("string")).cast("binary")))


def each_folder(spark: SparkSession, folders: list[str], work) -> DataFrame:
    """(folder, ok, error): work(folder) for each, those that fail listed instead of ending the run.

    The work is a Spark job of its own; what is kept here is a line for each folder.
    """
    lines = []
    for f in folders:
        try:
            work(f)
            lines.append((f, True, None))
        except Exception as e:  # noqa: BLE001  whatever a folder's job ends with goes into its line
            lines.append((f, False, f"{type(e).__name__}: {e}".split("\n")[0][:300]))
    return spark.createDataFrame(lines, "folder string, ok boolean, error string")


def read_folder_stats(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Every stats.json under a root."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "stats.json").option("multiLine", "true").json(root)


def upsert_results(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key from both tables."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc(at))
    return old.unionByName(new).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
