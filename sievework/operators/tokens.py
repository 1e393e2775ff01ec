"""Token sequences: vocabulary, encoding, decoding, chunking, framing, batches, masking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.text import draw, order_key, tokens
from sievework.schemas import BOS, EOS, FIRST_NATIVE, MASK_ID, PAD
from sievework.session import stored


#: Words of the vocabulary that are broadcast, at most.
HEAD = 200_000


@dataclass(frozen=True)
class ChunkRule:
    """Framed chunk size, least size of a short piece, size always skipped, and the two switches."""

    chunk_size: int = 1024
    min_size: int = 800
    always_skip: int = 500
    backfill: bool = True
    enforce_zeroth: bool = False

    @property
    def body(self) -> int:
        return self.chunk_size - 2


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(tok, n, tok_id): words by falling count, then by the word; ids begin at FIRST_NATIVE.

    Counts are pre-aggregated before the shuffle.  The ordinal over all words is two-level, so no task
    sorts the whole vocabulary: see sampling.ordinal.
    """
    from sievework.operators.sampling import ordinal

    n = docs.select(F.explode(tokens(F.col(text))).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    return ordinal(n, [F.desc("n"), F.asc("tok")], "rn").select("tok", "n", (F.col("rn") + (FIRST_NATIVE - 1)).cast("bigint").alias("tok_id"))


def encode(docs: DataFrame, vocab: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, input_ids): words as ids in their order; documents without words give no row.

    Rows stay apart whatever their keys: rows of one key, or without a key, come back as they went in.  Ids rise as
    counts fall, so the HEAD words with the smallest ids are nearly all places of any text: they are looked up in
    a broadcast table of that bounded size.  See look_up().
    """
    got = look_up(docs, key, tokens(F.col(text)), vocab.select("tok", "tok_id"), "tok", "tok_id", F.col("tok_id") < FIRST_NATIVE + HEAD)
    return got.select(key, F.col("__got").alias("input_ids"))


def look_up(df: DataFrame, key: str, values: Column, table: DataFrame, by: str, what: str, frequent: Column, other: Callable[[list], list] | None = None) -> DataFrame:
    """(key, __got): the array `values` of each row with each element replaced by the `what` of its row in `table`.

    Elements that the table lacks are left out, and rows of which nothing is left.  The `frequent` part of the table, which
    must be of bounded size, is numbered and broadcast: arrays are exploded to parts of bounded length, whose elements are looked
    up and put together again as they stream by, without a shuffle or a sort.  If the table has more, each row is stored once,
    as packed numbers and the elements not yet found; only these are shuffled to the rest of the table, and only rows that have
    any, still packed, to what it gave.  Where a function `other` gives the values of elements that the broadcast part lacks,
    it is asked as the parts stream by, for each of them once a step, and nothing is stored or shuffled.
    """
    spark = df.sparkSession
    kind = df.select(values.alias("__v")).schema["__v"].dataType.elementType
    types = {key: df.schema[key].dataType, by: kind, what: table.schema[what].dataType}
    head = table.where(frequent & F.col(what).isNotNull()).select(F.col(by).cast(kind), what).toArrow().combine_chunks()
    known = spark.sparkContext.broadcast(tuple(_one(head[c]) for c in (by, what)))
    rest = table.where(~frequent & F.col(what).isNotNull()).select(by, what)
    more = other is None and not rest.isEmpty()

    rows = df.select(F.col(key), values.alias("__v")).withColumn("__row", F.monotonically_increasing_id())
    cuts = F.when(F.size("__v") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("__v") - 1) / PART).cast("int")), lambda k: F.slice("__v", k * PART + 1, F.lit(PART))))
    parts = rows.select(F.col(key).alias("key"), "__row", F.posexplode(cuts).alias("pos", "part"))
    got = T.StructType([T.StructField(key, types[key]), T.StructField("__got", T.ArrayType(types[what]))])
    if not more:
        return parts.mapInArrow(_together(False, known, other), got)
    packed = T.StructType([T.StructField(key, types[key]), T.StructField("__row", T.LongType()), T.StructField("__ids", T.BinaryType()), T.StructField("__at", T.ArrayType(T.IntegerType())), T.StructField("__by", T.ArrayType(types[by]))])
    coded = stored(parts.mapInArrow(_together(True, known), packed), "rows")
    none = F.array().cast(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("w", types[what])])))
    lacking = coded.where(F.size("__at") > 0)
    wanted = lacking.select("__row", F.explode(F.arrays_zip("__at", "__by")).alias("z")).select("__row", F.col("z.__at").alias("at"), F.col("z.__by").alias(by))
    given = wanted.join(rest, by).groupBy("__row").agg(F.collect_list(F.struct("at", F.col(what).alias("w"))).alias("__a"))
    late = lacking.select(key, "__row", "__ids").join(given, "__row", "left").select(key, "__ids", F.coalesce("__a", none).alias("__a"))
    return coded.where(F.size("__at") == 0).select(key, "__ids", none.alias("__a")).unionByName(late).mapInArrow(_unpacked(known), got)


#: Elements of a part of an array, at most, and elements that are looked up in one step, about.
PART, _STEP = 1 << 16, 1 << 20


def _together(more: bool, known, other=None):
    """From parts of arrays in their order (key, __row, pos, part) to rows: (key, __got), or packed ones with what was not found.

    `other` gives what was not found.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def rows(held, at_end: bool):
            """One batch of the whole rows in `held`, and the parts of the row that may go on."""
            t = pa.Table.from_batches(held).combine_chunks()
            pos, ids = t["pos"].to_numpy(), t["__row"].to_numpy()
            start = np.flatnonzero(pos == 0)
            end = len(pos) if at_end else int(start[-1])
            start = start[start < end]
            size = np.diff(np.append(start, end))
            if not np.array_equal(pos[:end], np.arange(end) - np.repeat(start, size)) or not np.array_equal(ids[:end], np.repeat(ids[start], size)):
                raise ValueError("the parts of a row came in another order")
            left, t = t.slice(end).to_batches(), t.slice(0, end)
            part = _one(t["part"])
            edge = np.append(0, np.cumsum(part.value_lengths().to_numpy()))[np.append(start, end)]
            values = part.flatten()
            number = pc.index_in(values, value_set=known.value[0]).fill_null(-1).to_numpy()
            key = _one(t["key"]).take(pa.array(start))
            lost = number < 0
            if not more:
                found = known.value[1]
                if other is not None and lost.any():
                    rare = values.filter(pa.array(lost)).dictionary_encode()
                    number = np.where(lost, 0, number)
                    number[lost] = len(found) + rare.indices.to_numpy()
                    found = pa.concat_arrays([found, pa.array(other(rare.dictionary.to_pylist()), found.type)])
                return pa.RecordBatch.from_arrays(_whole(key, edge, number, found), names=["key", "__got"]), left
            packed = [_pack(number[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            there = pa.array(np.append(0, np.cumsum(lost))[edge].astype(np.int32))
            at = (np.arange(len(number)) - np.repeat(edge[:-1], np.diff(edge)))[lost].astype(np.int32)
            lists = [pa.ListArray.from_arrays(there, v) for v in (pa.array(at), values.filter(pa.array(lost)))]
            return pa.RecordBatch.from_arrays([key, pa.array(ids[start]), pa.array(packed, pa.binary()), *lists], names=["key", "__row", "__ids", "__at", "__by"]), left

        held: list = []
        size = 0
        whole = False  # whether a row has ended in `held`
        for batch in batches:
            for b in _steps(batch, batch.column(3).value_lengths().to_numpy()):
                whole = whole or np.count_nonzero(b.column(2).to_numpy() == 0) > (not held)
                held.append(b)
                size += len(b.column(3).flatten())
                if size >= _STEP and whole:
                    out, held = rows(held, False)
                    size, whole = sum(len(x.column(3).flatten()) for x in held), False
                    yield out
        if held:
            yield rows(held, True)[0]

    return run


def _one(column):
    """A column as one Arrow array."""
    import pyarrow as pa

    if not isinstance(column, pa.ChunkedArray):
        return column
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _steps(batch, sizes):
    """A batch in slices of about _STEP elements."""
    import numpy as np

    step = np.cumsum(sizes) // _STEP
    cut = np.append(np.flatnonzero(np.append(True, step[1:] != step[:-1])), len(step)).tolist() if len(step) else [0]
    for a, b in zip(cut[:-1], cut[1:]):
        yield batch.slice(a, b - a)


def _whole(key, edge, number, values) -> list:
    """Keys and arrays of the rows between the edges: the values of their numbers, none for -1, and no row without any."""
    import numpy as np
    import pyarrow as pa

    there = number >= 0
    cut = np.append(0, np.cumsum(there))[edge]
    some = np.diff(cut) > 0
    return [key.filter(pa.array(some)), pa.ListArray.from_arrays(pa.array(np.append(cut[:-1][some], cut[-1]).astype(np.int32)), values.take(pa.array(number[there])))]


def _pack(numbers) -> bytes:
    """Numbers as compressed bytes, with their count before them."""
    import numpy as np
    import pyarrow as pa

    raw = np.ascontiguousarray(numbers, np.int32)
    return len(raw).to_bytes(4, "little") + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes):
    import numpy as np
    import pyarrow as pa

    return np.frombuffer(pa.decompress(data[4:], 4 * int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True), np.int32)


def _unpacked(known):
    """From packed rows (key, __ids, __a: places and values found later) to (key, __got)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for b in _steps(batch, [int.from_bytes(x.as_py()[:4], "little") for x in batch.column(1)]):
                each = [_unpack(x.as_py()) for x in b.column(1)]
                number, edge = np.concatenate(each), np.append(0, np.cumsum([len(x) for x in each]))
                late, values = b.column(2).flatten(), known.value[1]
                if len(late):
                    number[np.repeat(edge[:-1], b.column(2).value_lengths().to_numpy()) + late.field(0).to_numpy()] = len(values) + np.arange(len(late))
                    values = pa.concat_arrays([values, late.field(1).cast(values.type)])
                yield pa.RecordBatch.from_arrays(_whole(b.column(0), edge, number, values), names=["key", "__got"])

    return run


def decode(ids: DataFrame, vocab: DataFrame, key: str = "doc_id", column: str = "input_ids") -> DataFrame:
    """(key, text): words of the ids joined by spaces, reserved ids left out; rows stay apart as in encode()."""
    own = F.filter(F.col(column), lambda x: ~x.isin(BOS, EOS, PAD, MASK_ID))
    got = look_up(ids, key, own, vocab.select("tok", "tok_id"), "tok_id", "tok", F.col("tok_id") < FIRST_NATIVE + HEAD)
    return got.select(key, F.array_join("__got", " ").alias("text"))


def append_eos(ids: Column) -> Column:
    """EOS at the end, once (T4)."""
    return F.when(F.try_element_at(ids, F.lit(-1)) == EOS, ids).otherwise(F.concat(ids, F.array(F.lit(EOS).cast("bigint"))))


def frame(body: Column) -> Column:
    """BOS, body, EOS."""
    return F.concat(F.array(F.lit(BOS).cast("bigint")), body, F.array(F.lit(EOS).cast("bigint")))


def non_pad(ids: Column, pad: int = PAD) -> Column:
    """Number of ids other than padding (P5)."""
    return F.size(F.filter(ids, lambda x: x != pad))


def plan_chunks(df: DataFrame, rule: ChunkRule, key: str, n: str = "n") -> DataFrame:
    """`df` with nc (chunks), borrowed, and skipped (tokens), in closed form from each row's token count.

    Only the last piece of a row can be short: below always_skip it is skipped (the zeroth only if
    enforced); below min_size it is kept if it is the zeroth, else it borrows a hash-drawn number of
    tokens from the piece before (backfill) or is skipped.
    """
    c, m, a = rule.body, rule.min_size, rule.always_skip
    n_ = F.col(n).cast("bigint")
    k, rem = F.floor(n_ / c).cast("bigint"), (n_ % c).cast("bigint")
    gone = (k == 0) & (n_ > 0) & (n_ < a) if rule.enforce_zeroth else F.lit(False)
    short = rem < (a if rule.backfill else max(a, m))
    nc = F.when(n_ == 0, 0).when(gone, 0).when(rem == 0, k).when(k == 0, 1).when(short, k).otherwise(k + 1).cast("bigint")
    lend = (k > 0) & (rem > 0) & (rem >= a) & (rem < m) if rule.backfill else F.lit(False)
    borrowed = F.when(lend, draw(F.col(key)) % (F.lit(c).cast("bigint") - rem)).otherwise(F.lit(0)).cast("bigint")
    skipped = F.when(gone, n_).when((k > 0) & (rem > 0) & short, rem).otherwise(F.lit(0)).cast("bigint")
    return df.withColumns({"k": k, "rem": rem, "nc": nc, "borrowed": borrowed, "skipped": skipped})


def chunk_spans(df: DataFrame, rule: ChunkRule, key: str, n: str = "n") -> DataFrame:
    """One row for each chunk: the columns of `df`, chunk_no, start (from 0) and len of its body."""
    p = plan_chunks(df, rule, key, n).where("nc > 0").withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nc") - 1)))
    i, c = F.col("chunk_no"), F.lit(rule.body).cast("bigint")
    own = (i == F.col("k")) & (F.col("k") > 0)
    return p.withColumns({
        "start": i * c - F.when(own, F.col("borrowed")).otherwise(0),
        "len": F.when(i < F.col("k"), c).otherwise(F.col("rem")) + F.when(own, F.col("borrowed")).otherwise(0) - F.when((i == F.col("k") - 1) & (F.col("rem") > 0), F.col("borrowed")).otherwise(0),
    })


def chunk(df: DataFrame, rule: ChunkRule, key: str, ids: str = "input_ids") -> DataFrame:
    """(key, chunk_no, input_ids, len): framed chunks of every row."""
    spans = chunk_spans(df.withColumn("n", F.size(ids).cast("bigint")), rule, key)
    return spans.select(key, "chunk_no", frame(F.slice(F.col(ids), (F.col("start") + 1).cast("int"), F.col("len").cast("int"))).alias("input_ids"), (F.col("len") + 2).alias("len"))


def batches(df: DataFrame, key: str, size: int, seed: int, drop_last: bool = True) -> DataFrame:
    """`df` with rn and batch_no in a seeded random order; an incomplete last batch is left out."""
    from sievework.operators.sampling import permute

    out = permute(df, key, seed).withColumn("batch_no", F.floor((F.col("rn") - 1) / size).cast("bigint"))
    if not drop_last:
        return out
    total = df.agg(F.floor(F.count(F.lit(1)) / size).cast("bigint").alias("full"))
    return out.join(F.broadcast(total), F.col("batch_no") < F.col("full")).drop("full")  # one row


def mask_flags(key: Column, n: Column, rate: float) -> Column:
    """For each of n places whether it is masked, a draw of its own for each.

    One md5 of the key serves four places: each takes eight of its digits, which are compared with the rate as they are.
    """
    below = F.lit(f"{int(rate * 2**32):08x}") if rate < 1 else F.lit("g")
    hashes = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 4).cast("int")), lambda q: order_key(key, q))
    places = F.flatten(F.transform(hashes, lambda h: F.array(*[F.substring(h, 8 * k + 1, 8) < below for k in range(4)])))
    return F.when(n > 0, F.slice(places, F.lit(1), n)).otherwise(F.array().cast("array<boolean>"))


def mask_ids(ids: Column, key: Column, rate: float) -> Column:
    """The ids with MASK_ID in the places that mask_flags() says; the row keeps its length and is not shuffled."""
    return F.zip_with(ids, mask_flags(key, F.size(ids), rate), lambda x, m: F.when(m, F.lit(MASK_ID).cast("bigint")).otherwise(x))


def encode_with(docs: DataFrame, tokenizer: Callable[[list[str]], list[list[int]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, input_ids) by any tokenizer: a function from texts to lists of ids, run on Arrow batches.

    A null text is an empty one.  The function is sent to the workers; what it loads, it should load there.
    """

    def run(batches):
        for pdf in batches:
            yield pdf.assign(input_ids=tokenizer(["" if t is None else t for t in pdf.pop("__text")]))

    src = docs.select(F.col(key), F.col(text).alias("__text"))
    return src.mapInPandas(run, T.StructType([src.schema[key], T.StructField("input_ids", T.ArrayType(T.LongType()))]))


def checked_frames(chunks: DataFrame, rule: ChunkRule, ids: str = "input_ids") -> DataFrame:
    """`chunks`, but an error where one is not framed or too long."""
    ok = (F.element_at(ids, 1) == BOS) & (F.element_at(ids, -1) == EOS) & (F.size(ids) <= rule.chunk_size)
    return chunks.where(F.assert_true(ok, F.lit("a chunk is not framed or too long")).isNull())


def warm_up_batch(cumulative: Column, warm_tokens: int, start: int, full: int) -> Column:
    """Batch size that grows in proportion to the tokens seen until warm_tokens (T17, the growth rule is ours)."""
    return F.when(cumulative < warm_tokens, F.greatest(F.lit(start), F.floor(F.lit(full) * cumulative / warm_tokens).cast("int"))).otherwise(F.lit(full))


