"""A dataset addressed by configuration and split, read in blocks of rows, at once or as a stream with a saved position."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Fixed value: rows of a block, which becomes one folder of records.
BLOCK_ROWS = 30_000


@dataclass
class Block(InputPartition):
    """Rows of one block: (file, first row, row after the last, ordinal of the first) of each piece."""

    number: int
    pieces: list[tuple[str, int, int, int]]


class Corpus:
    """The files of <path>/<config>/<split>, a folder or one Parquet file, in the order in which they came or of their names.

    The address may be in any store that Arrow reaches.  Only footers are read here.
    """

    def __init__(self, options: dict):
        self.root = "/".join(x.strip("/") if k else x.rstrip("/") for k, x in enumerate((options["path"], options.get("config", ""), options.get("split", ""))) if x)
        self.root = re.sub("^file:/(?!/)", "file:///", self.root)
        self.by_name = {"time": False, "name": True}[options.get("order", "time")]
        self.columns = [c.strip() for c in options["columns"].split(",")] if options.get("columns") else None
        self.rows = int(options.get("blockrows", BLOCK_ROWS))
        self.at = sorted({int(x) for x in options["at"].split(",")}) if options.get("at") else None

    def files(self) -> list[tuple[int, str, int]]:
        """(time, name, rows) of each file, by time and then by name; or by name alone, numbers in it as numbers."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        infos = store.get_file_info([top, f"{top}.parquet"])
        found = [i for i in infos if i.is_file]
        for i in infos:
            if i.type == fs.FileType.Directory:
                found += [x for x in store.get_file_info(fs.FileSelector(i.path, recursive=True)) if x.is_file and x.extension == "parquet" and not x.base_name.startswith(("_", "."))]
        out = sorted((i.mtime_ns, i.path, pq.read_metadata(i.path, filesystem=store).num_rows) for i in found)
        return sorted(out, key=lambda f: [int(x) if x.isdigit() else x for x in re.split("([0-9]+)", f[1])]) if self.by_name else out

    def schema(self) -> T.StructType:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        store, files = self.store(), self.files()
        if not files:
            raise ValueError(f"no Parquet file at {self.root}")
        whole = from_arrow_schema(pq.read_schema(files[0][1], filesystem=store))
        kept = [f for f in whole.fields if self.columns is None or f.name in self.columns]
        if self.columns and len(kept) < len(self.columns):
            raise ValueError(f"{sorted(set(self.columns) - {f.name for f in kept})} not in {whole.names}")
        return T.StructType([*kept, T.StructField("_block", T.LongType()), T.StructField("_row", T.LongType())])

    def store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)[0] if "://" in self.root else fs.LocalFileSystem()

    def blocks(self, files: list[tuple[int, str, int]], first: int) -> list[Block]:
        """The files' rows, whose first has the ordinal `first`, cut at multiples of the block size."""
        out: list[Block] = []
        at = first
        for _, name, n in files:
            row = 0
            while row < n:
                number = at // self.rows
                take = min(n - row, (number + 1) * self.rows - at)
                if not out or out[-1].number != number:
                    out.append(Block(number, []))
                out[-1].pieces.append((name, row, row + take, at))
                row, at = row + take, at + take
        if self.at is None:
            return out
        # of the blocks, pieces and rows only those that hold a wanted ordinal: one piece for each
        wanted = [Block(b.number, [(name, row + r - first, row + r - first + 1, r) for name, row, end, first in b.pieces for r in self.at[bisect_left(self.at, first) : bisect_left(self.at, first + end - row)]]) for b in out]
        return [b for b in wanted if b.pieces]

    def read(self, block: Block) -> Iterator:
        """Record batches of a block: the wanted columns only, and the row groups that it touches only."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        store = self.store()
        for name, a, b, at in block.pieces:
            with pq.ParquetFile(name, filesystem=store) as f:
                begin = 0
                for g in range(f.num_row_groups):
                    end = begin + f.metadata.row_group(g).num_rows
                    if begin < b and end > a:
                        row = begin
                        for batch in f.iter_batches(batch_size=4096, row_groups=[g], columns=self.columns):
                            lo, hi = max(a - row, 0), min(b - row, batch.num_rows)
                            if lo < hi:
                                part = batch.slice(lo, hi - lo)
                                ordinal = pa.array(range(at + row + lo - a, at + row + hi - a), pa.int64())
                                number = pa.array([block.number] * (hi - lo), pa.int64())
                                names = self.columns or part.schema.names
                                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in part.schema.names if c in names], number, ordinal], names=[*[c for c in part.schema.names if c in names], "_block", "_row"])
                            row += batch.num_rows
                            if row >= b:
                                break
                    begin = end


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict):
        self.corpus = Corpus(options)

    def partitions(self) -> list[Block]:
        return self.corpus.blocks(self.corpus.files(), 0)

    def read(self, partition: Block) -> Iterator:
        return self.corpus.read(partition)


class CorpusStream(DataSourceStreamReader):
    """A position is the last file taken and the number of rows up to its end."""

    def __init__(self, options: dict):
        self.corpus = Corpus(options)

    def initialOffset(self) -> dict:
        return {"time": 0, "file": "", "rows": 0}

    def latestOffset(self) -> dict:
        files = self.corpus.files()
        return {"time": files[-1][0], "file": files[-1][1], "rows": sum(f[2] for f in files)} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Block]:
        new = [f for f in self.corpus.files() if (start["time"], start["file"]) < f[:2] <= (end["time"], end["file"])]
        return self.corpus.blocks(new, start["rows"])

    def read(self, partition: Block) -> Iterator:
        return self.corpus.read(partition)

    def commit(self, end: dict) -> None:
        pass


class CorpusSource(DataSource):
    """Format "corpus": options path, config, split, columns (names with commas), blockRows and order (time, or name in batch)."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> T.StructType:
        return Corpus(self.options).schema()

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(self.options)

    def streamReader(self, schema) -> CorpusStream:
        if self.options.get("order", "time") != "time":
            raise ValueError("a stream takes files by their times")
        return CorpusStream(self.options)


def _options(path: str, config: str, split: str, columns: list[str] | None, block_rows: int, order: str = "time") -> dict[str, str]:
    return {"path": path, "config": config, "split": split, "columns": ",".join(columns or []), "blockRows": str(block_rows), "order": order}


def read(spark: SparkSession, path: str, config: str = "", split: str = "", columns: list[str] | None = None, block_rows: int = BLOCK_ROWS, order: str = "time") -> DataFrame:
    """The rows of one configuration and split, of the wanted columns only, with _block and _row.

    A row's ordinal (_row) counts all rows in the order of the files, by their times or (order="name") their names; a block
    of block_rows of them is one task.
    """
    spark.dataSource.register(CorpusSource)
    return spark.read.format("corpus").options(**_options(path, config, split, columns, block_rows, order)).load()


def write_sorted(rows: DataFrame, path: str, order: list[Column]) -> None:
    """`rows` sorted by range in files whose names rise with `order`: read with order="name", _row is the place in it.

    Files hold BLOCK_ROWS rows at most, so that a reader of a block decodes little besides.
    """
    from sievework.sources.files import write_records

    write_records(rows.repartitionByRange(*order).sortWithinPartitions(*order), path, rows_per_file=BLOCK_ROWS)


def read_rows(spark: SparkSession, ordinals: list[int], path: str, config: str = "", split: str = "", columns: list[str] | None = None, block_rows: int = BLOCK_ROWS, order: str = "time") -> DataFrame:
    """Of read() the rows with these ordinals: other blocks are no tasks, other files and row groups are not opened.

    Ordinals beyond the last row give nothing; an ordinal given twice gives one row.
    """
    spark.dataSource.register(CorpusSource)
    if not ordinals:
        return read(spark, path, config, split, columns, block_rows, order).limit(0)
    return spark.read.format("corpus").options(**_options(path, config, split, columns, block_rows, order), at=",".join(map(str, ordinals))).load()


def read_stream(spark: SparkSession, path: str, config: str = "", split: str = "", columns: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """read() as a stream: a run takes the files that came after the saved position, and goes on numbering.

    Files must not change once they are there, and come with later times than those before them.
    """
    spark.dataSource.register(CorpusSource)
    return spark.readStream.format("corpus").options(**_options(path, config, split, columns, block_rows)).load()
