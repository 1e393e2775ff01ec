"""Subword tokenizers by name: every frequent piece of the corpus is encoded once, texts are put together by lookup."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators.tokens import HEAD, look_up
from sievework.schemas import BOS, EOS
from sievework.session import stored

#: Fixed value: the split of a text into pieces before byte-level merges, with Unicode classes.
PIECES = r"(?U)('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+)"

#: Chunks that are decoded and encoded in one call.
CHUNKS = 1000


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer of the registry: the file of its vocabulary on every worker, and what loads it.

    load(path) gives two functions, from texts to lists of ids and back.  `byte_level` says that pieces of
    PIECES are merged each for itself, so that they can be encoded apart.
    """

    path: str
    load: Callable[[str], tuple[Callable[[list[str]], list[list[int]]], Callable[[list[list[int]]], list[str]]]]
    byte_level: bool = True


_REGISTRY: dict[str, Tokenizer] = {}


def register(name: str, tokenizer: Tokenizer) -> None:
    """Gives a tokenizer a name; a later one of that name takes its place."""
    _REGISTRY[name] = tokenizer


def by_name(name: str) -> Tokenizer:
    if name not in _REGISTRY:
        raise KeyError(f"no tokenizer is called {name!r}; there are {sorted(_REGISTRY)}")
    return _REGISTRY[name]


@functools.lru_cache(maxsize=8)
def loaded(tokenizer: Tokenizer):
    """The functions of a tokenizer, loaded once for each worker."""
    return tokenizer.load(tokenizer.path)


def load_json(path: str):
    """A vocabulary file of the tokenizers library; special strings in texts are ordinary text."""
    from tokenizers import Tokenizer as Library

    t = Library.from_file(path)
    t.encode_special_tokens = True
    return (lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]), (lambda ids: t.decode_batch(ids, skip_special_tokens=False))


def load_ranks(path: str):
    """A file of merge ranks in base 64; one id each line."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding("ranks", pat_str=PIECES.removeprefix("(?U)"), mergeable_ranks=ranks, special_tokens={})
    return (lambda texts: [t.encode_ordinary(x) for x in texts]), (lambda ids: [t.decode(x) for x in ids])


def load_pieces(path: str):
    """A model file of the sentencepiece library."""
    import sentencepiece

    t = sentencepiece.SentencePieceProcessor(model_file=path)
    return (lambda texts: t.encode(texts, num_threads=1)), (lambda ids: t.decode(ids))


def pieces(text: Column, prefix_space: bool = True) -> Column:
    """The pieces of a text in order; with prefix_space a text that does not begin with a space gets one."""
    led = F.when(text.startswith(" ") | (text == ""), text).otherwise(F.concat(F.lit(" "), text)) if prefix_space else text
    return F.regexp_extract_all(led, F.lit(PIECES), F.lit(1))


def _piece_counts(docs: DataFrame, name: str, text: str, prefix_space: bool) -> DataFrame:
    """(piece, n): the distinct pieces of the texts; counts are summed before the shuffle."""
    if not by_name(name).byte_level:
        raise ValueError(f"{name} merges across pieces; use encode_whole")
    return docs.select(F.explode(pieces(F.col(text), prefix_space)).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def _coded(counts: DataFrame, name: str) -> DataFrame:
    """(piece, n, ids): a piece is one call's work however often it stands."""
    t = by_name(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, _ = loaded(t)
        for pdf in batches:
            yield pdf.assign(ids=encode(pdf["piece"].tolist()))

    return counts.mapInPandas(run, "piece string, n long, ids array<long>")


def piece_table(docs: DataFrame, name: str, text: str = "text", prefix_space: bool = True) -> DataFrame:
    """(piece, n, place, ids): the distinct pieces of the texts by falling count, each encoded once (T2). Stored."""
    from sievework.operators.sampling import ordinal

    return stored(ordinal(_coded(_piece_counts(docs, name, text, prefix_space), name), [F.desc("n"), F.asc("piece")], "place"), "pieces")


def head_table(docs: DataFrame, name: str, text: str = "text", prefix_space: bool = True) -> DataFrame:
    """(piece, n, ids) of the most frequent pieces that come twice or more, at most HEAD: whole classes of counts that differ by 5 % or less.

    Only pieces that come twice are stored, and no ordinal is needed: totals of at most 1,100 classes say where to end.
    """
    again = stored(_piece_counts(docs, name, text, prefix_space).where("n > 1").withColumn("class", F.floor(16 * F.log2("n")).cast("int")), "counts")
    total, least = 0, None
    for r in again.groupBy("class").count().orderBy(F.desc("class")).collect():
        total += r["count"]
        if total > HEAD:
            break
        least = r["class"]
    return _coded(again.where(F.col("class") >= least if least is not None else F.lit(False)).select("piece", "n"), name)


def encode(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text", prefix_space: bool = True, table: DataFrame | None = None) -> DataFrame:
    """(key, input_ids) by the tokenizer `name`, neither truncated nor padded.

    The ids of a text are those of its pieces one after the other.  Those of head_table() are encoded once and looked up by
    broadcast; others are encoded where they stand, each once in about a million places, so that nothing but counts is
    shuffled.  With a `table` (piece_table()) the others come from there, by a shuffle of their places.  Null and empty texts
    give no row; repeated rows, and rows of one key or none, stay apart; very long texts are whole.
    """
    values = pieces(F.col(text), prefix_space)
    if table is None:
        t = by_name(name)
        got = look_up(docs, key, values, head_table(docs, name, text, prefix_space), "piece", "ids", F.lit(True), lambda x: loaded(t)[0](x))
    else:
        got = look_up(docs, key, values, table.select("piece", "ids", "place"), "piece", "ids", F.col("place") <= HEAD)
    return got.select(key, F.flatten("__got").alias("input_ids"))


def encode_whole(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """encode() for tokenizers whose merges cross pieces: whole texts in Arrow batches, an empty list for a null text."""
    from sievework.operators.tokens import encode_with

    t = by_name(name)
    return encode_with(docs, lambda texts: loaded(t)[0](texts), key, text)


def decode(rows: DataFrame, name: str, column: str = "input_ids", out: str = "text") -> DataFrame:
    """`rows` with the text of the ids, BOS and EOS left out."""
    t = by_name(name)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        _, back = loaded(t)
        for s in batches:
            yield pd.Series(back([[int(x) for x in ids if x not in (BOS, EOS)] for ids in s]), dtype=object)

    return rows.withColumn(out, F.when(F.col(column).isNotNull(), run(F.coalesce(column, F.array().cast("array<long>")))))


def reencode(chunks: DataFrame, name: str, chunk_size: int, key: str = "doc_id", ids: str = "input_ids") -> DataFrame:
    """(key, chunk_no, input_ids, len, lost) of chunks (key, chunk_no, ids): each begins with a space and with BOS.

    A chunk needs no other one, so chunks are taken where they are, without a shuffle.  A chunk whose text begins with a space
    stays as it is; another one is encoded anew with a space before it, which may change its length, and is cut to
    chunk_size ids with BOS and EOS; lost counts the ids that the cut has taken.  A chunk of special ids alone stays as it is; a null
    chunk gives no row; repeated rows, and rows of a null key, stay apart.
    """
    t = by_name(name)

    def run(batches):
        import pyarrow as pa

        encode, back = loaded(t)
        for batch in batches:
            for b in (batch.slice(k, CHUNKS) for k in range(0, batch.num_rows, CHUNKS)):
                b = b.filter(b.column(2).is_valid())
                own, lost = b.column(2).to_pylist(), [0] * b.num_rows
                texts = back([[x for x in ids if x not in (BOS, EOS)] for ids in own])
                led = [bool(x) and not x.startswith(" ") for x in texts]
                anew = iter(encode([" " + x for x, y in zip(texts, led) if y]))
                for k, y in enumerate(led):
                    if y:
                        new = [BOS, *next(anew), EOS]
                        own[k], lost[k] = new[:chunk_size], max(0, len(new) - chunk_size)
                    elif not own[k] or own[k][0] != BOS:
                        own[k] = [BOS, *own[k]]
                columns = [b.column(0), b.column(1), pa.array(own, pa.list_(pa.int64())), pa.array([len(x) for x in own], pa.int64()), pa.array(lost, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "chunk_no", "input_ids", "len", "lost"])

    src = chunks.select(F.col(key), F.col("chunk_no").cast("long").alias("chunk_no"), F.col(ids).cast("array<long>").alias("input_ids"))
    return src.mapInArrow(run, T.StructType([*src.schema, T.StructField("len", T.LongType()), T.StructField("lost", T.LongType())]))


def _public() -> None:
    """The public vocabularies that are installed here, under their file names."""
    try:
        import public_tokenizers as found
    except ImportError:
        return
    for file, load, byte_level in (("byte_bpe_50k.json", load_json, False), ("byte_bpe_50k.tiktoken", load_ranks, True), ("byte_bpe_multi_50k.tiktoken", load_ranks, True), ("word_bpe_49k.json", load_json, False), ("piece_bpe_32k.model", load_pieces, False)):
        register(file.rsplit(".", 1)[0] if load is not load_json else file, Tokenizer(found.path(file), load, byte_level))


_public()
