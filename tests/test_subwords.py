"""Encoding with row identity, tokenizers by name, re-encoded chunks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievework.functions.text import tokens as words
from sievework.operators import subwords, tokens
from sievework.schemas import BOS, EOS

SMALL = "/root/testdata/sf0.001"
NAME = "byte_bpe_50k"


@pytest.mark.parametrize("head", [200_000, 2])
def test_rows_of_one_key_or_none_stay_apart(spark, monkeypatch, head):
    monkeypatch.setattr(tokens, "HEAD", head)
    docs = [(1, "a b"), (1, "c d e"), (1, "c d e"), (None, "b b"), (None, "a"), (2, None), (3, ""), (4, "e d c b a " * 500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    v = tokens.vocabulary(df)
    coded = tokens.encode(df, v)
    back = Counter((r.doc_id, r.text) for r in tokens.decode(coded, v).collect())
    assert back == Counter((i, " ".join(t.split())) for i, t in docs if t and t.split())


def test_head_needs_no_exchange_after_the_explode(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = tokens.encode(df, tokens.vocabulary(df))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate posexplode")]
    assert "Exchange hashpartitioning" not in above and "Exchange rangepartitioning" not in above.split("BroadcastExchange")[0]


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(1)
    odd = ["", " lead", "no lead", "tabs\t\tand\nlines \n", "it's we'll I'd", "naïve café ½ ２３ 12,345", "你好 世界　x", "\U0001f600\U0001f600 é", "a" * 3000, " nbsp em  two ", "<|endoftext|>", " \x1c \x85 end"]
    rows = [(k, t) for k, t in enumerate(odd)] + [(100, "".join(rnd.choice("ab 'sé1\n.一") for _ in range(400))), (0, "again"), (None, "no key"), (None, None)]
    return rows + [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()]


@pytest.mark.parametrize("name,head", [(NAME, 200_000), (NAME, 50), ("byte_bpe_multi_50k", 200_000)])
def test_same_ids_as_whole_texts(spark, monkeypatch, texts, name, head):
    monkeypatch.setattr(subwords, "HEAD", head)
    got = Counter((r.doc_id, tuple(r.input_ids)) for r in subwords.encode(spark.createDataFrame(texts, "doc_id long, text string"), name).collect())
    encode, _ = subwords.loaded(subwords.by_name(name))
    assert got == Counter((i, tuple(encode([t if t.startswith(" ") else " " + t])[0])) for i, t in texts if t)


def test_a_piece_is_encoded_once(spark):
    df = spark.createDataFrame([(k, "the cat the dog") for k in range(50)], "doc_id long, text string")
    table = {r.piece: (r.n, r.place) for r in subwords.piece_table(df, NAME).collect()}
    assert table == {" the": (100, 1), " cat": (50, 2), " dog": (50, 3)}


@pytest.mark.parametrize("name", [NAME, "byte_bpe_50k.json", "piece_bpe_32k"])
def test_round_trip_by_name(spark, name):
    rows = [(1, " plain words, and 12 numbers"), (2, " naïve 你好")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    coded = subwords.encode(df, name) if subwords.by_name(name).byte_level else subwords.encode_whole(df, name)
    assert {r.doc_id: r.text.strip() for r in subwords.decode(coded, name).collect()} == {i: t.strip() for i, t in rows}


def test_unknown_names(spark):
    with pytest.raises(KeyError, match="no tokenizer"):
        subwords.by_name("none")
    with pytest.raises(ValueError, match="across pieces"):
        subwords.piece_table(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "piece_bpe_32k")


def test_reencoded_chunks_conserve_their_tokens(spark, texts):
    """Every chunk's text comes back with a space before it, in as many ids as fit; what is lost is counted."""
    df = spark.createDataFrame([(i, t) for i, t in texts if i is not None and t], "doc_id long, text string").dropDuplicates(["doc_id"])
    chunks = tokens.chunk(subwords.encode(df, NAME), tokens.ChunkRule(34, 10, 5), "doc_id").cache()
    out = {(r.doc_id, r.chunk_no): r for r in subwords.reencode(chunks, NAME, 34).collect()}
    encode, back = subwords.loaded(subwords.by_name(NAME))
    changed = lost = 0
    for r in chunks.collect():
        own = out.pop((r.doc_id, r.chunk_no))
        body = [x for x in r.input_ids if x not in (BOS, EOS)]
        text = back([body])[0]
        want = list(r.input_ids) if text.startswith(" ") else [BOS, *encode([" " + text])[0], EOS]
        assert list(own.input_ids) == want[:34] and own.len == len(own.input_ids) and own.len + own.lost == len(want)
        changed += want != list(r.input_ids)
        lost += own.lost
    assert not out and changed > 10


def test_reencode_odd_rows(spark):
    encode, _ = subwords.loaded(subwords.by_name(NAME))
    long = encode(["xylophone " * 30])[0]
    rows = [(1, 0, [BOS, EOS]), (1, 1, None), (None, 0, [5, 6]), (None, 0, [5, 6]), (2, 0, [BOS, *long, EOS]), (2, 1, [])]
    got = {(r.doc_id, r.chunk_no): r for r in subwords.reencode(spark.createDataFrame(rows, "doc_id long, chunk_no int, input_ids array<long>"), NAME, 20).collect()}
    assert list(got[1, 0].input_ids) == [BOS, EOS] and (1, 1) not in got and list(got[2, 1].input_ids) == [BOS]
    assert got[2, 0].len == 20 and got[2, 0].lost == len(encode([" " + "xylophone " * 30])[0]) + 2 - 20
    assert subwords.reencode(spark.createDataFrame([], "doc_id long, chunk_no int, input_ids array<long>"), NAME, 20).count() == 0
    assert F.col  # keeps the import for the fixtures


def test_only_places_of_rarer_words_are_shuffled(spark, monkeypatch):
    """Rows come back whole from parts of three words, and no exchange deals the texts themselves."""
    monkeypatch.setattr(tokens, "HEAD", 2)
    monkeypatch.setattr(tokens, "PART", 3)
    docs = [(1, "a b a c d a b e a a"), (1, "c d e"), (2, "a a a"), (3, ""), (None, "b f " * 20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    v = tokens.vocabulary(df)
    coded = tokens.encode(df, v)
    assert "REPARTITION" not in coded._jdf.queryExecution().executedPlan().toString()
    assert Counter((r.doc_id, r.text) for r in tokens.decode(coded, v).collect()) == Counter((i, " ".join(t.split())) for i, t in docs if t)


@pytest.mark.parametrize("head", [200_000, 3, 0])
def test_rare_pieces_are_encoded_where_they_stand(spark, monkeypatch, head):
    """No table of the rarer pieces is stored or joined, and no row or chunk is shuffled."""
    monkeypatch.setattr(subwords, "HEAD", head)
    monkeypatch.setattr(tokens, "PART", 3)
    rows = [(1, "the cat the dog"), (1, "the cat the dog"), (2, "a zebra, 12 é"), (None, "the é"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    coded = subwords.encode(df, NAME)
    encode, _ = subwords.loaded(subwords.by_name(NAME))
    assert Counter((r.doc_id, tuple(r.input_ids)) for r in coded.collect()) == Counter((i, tuple(encode([" " + t])[0])) for i, t in rows if t)
    out = subwords.reencode(tokens.chunk(coded, tokens.ChunkRule(4, 1, 0), "doc_id"), NAME, 4)
    assert sum(r.len - 2 + r.lost for r in out.collect()) >= sum(len(encode([" " + t])[0]) for _, t in rows if t)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_the_head_is_the_most_frequent_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(k, " a a a b b" + " c" * (k % 2) + " d" * (k == 0)) for k in range(40)], "doc_id long, text string")
    for head, want in ((9, {" a": 120, " b": 80, " c": 20}), (2, {" a": 120, " b": 80}), (0, {})):
        monkeypatch.setattr(subwords, "HEAD", head)
        assert {r.piece: r.n for r in subwords.head_table(df, NAME).collect()} == want


def test_words_are_split_without_a_function_for_each(spark):
    rows = [(None, []), ("", []), (" \t", []), (" a  b ", ["a", "b"]), ("\ta\x0bb\n\fc", ["a\x0bb", "c"])]
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, text string").select("k", words(F.col("text")).alias("w"))
    assert {r.k: r.w for r in got.collect()} == {k: w for k, (_, w) in enumerate(rows)}
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
