"""Session settings that the library is tested under."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; `settings` use double underscores for dots."""
    b = SparkSession.builder.appName("sievework")
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Shared folders that this process has made and not released.
_MADE: list[str] = []


def made(path: str) -> str:
    """Notes a folder of intermediate results for release()."""
    _MADE.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes the intermediate tables made so far, and says how many.

    Results are lazy: call it when the results of all queries begun so far have been written.  Checkpoint files
    go with their tables where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    n = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def stored(df: DataFrame, what: str) -> DataFrame:
    """Written once as a table in the shared folder and read again, so that no part of it is computed anew."""
    path = f"{shared_folder(df.sparkSession)}/{what}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local one only in local mode (tests), elsewhere it must be set."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return made(f"{root}/sievework-{uuid.uuid4().hex}" if root else tempfile.mkdtemp(prefix="sievework-"))
