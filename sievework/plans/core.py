"""Queries of groups 1 to 6: scans, tokens, joins, aggregates, order, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import text as fx
from sievework.operators import batching, relational, sampling, stats, subwords, tokens, tree
from sievework.operators.tokens import ChunkRule
from sievework.plans.registry import TOKENS, draw_sql, query
from sievework.session import shared_folder
from sievework.sources import export, files
from sievework.sources.files import table

SEED = 42
PERMUTED = f"md5(doc_id::VARCHAR || '-{SEED}')"
NTOK = f"len({TOKENS})::BIGINT"
N = f"WITH n AS (SELECT doc_id, source, {NTOK} AS n FROM documents) "


def counts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, n): documents and their token counts, nothing else of them."""
    return table(spark, d, "documents").select("doc_id", "source", F.size(fx.tokens(F.col("text"))).cast("bigint").alias("n"))


def folders(spark: SparkSession, d: str) -> DataFrame:
    return counts(spark, d).groupBy("source").agg(F.sum("n").cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("docs"))


# --- group 1: scans and projections

@query("s_registry_filter", "SELECT page_id, url FROM pages WHERE contains(url, 'blog')")
def s_registry_filter(s, d):
    return table(s, d, "pages").where(F.contains("url", F.lit("blog"))).select("page_id", "url")


@query("s_split_name", "SELECT page_id, replace(replace(string_split(url, '/')[-1], '.json.gz', ''), '-', '_') AS split_name FROM pages")
def s_split_name(s, d):
    return table(s, d, "pages").select("page_id", fx.split_name(F.col("url")).alias("split_name"))


@query("s_shard_assign", "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 128)::BIGINT AS folder FROM documents")
def s_shard_assign(s, d):
    return files.assign_shards(table(s, d, "documents").select("doc_id"), [F.asc("doc_id")], 128)


@query("s_line_range", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i >= 100 AND i < 350")
def s_line_range(s, d):
    return files.line_range(table(s, d, "documents").select("doc_id", "lang"), [F.asc("doc_id")], 100, 350)


@query("s_line_count", "SELECT count(*) AS n FROM documents")
def s_line_count(s, d):
    return table(s, d, "documents").agg(F.count(F.lit(1)).alias("n"))


@query("s_dtype_narrow", "SELECT doc_id::INTEGER AS doc_id, n_chars::INTEGER AS n_chars, lang FROM documents")
def s_dtype_narrow(s, d):
    return files.narrow(table(s, d, "documents"), ["doc_id", "n_chars", "lang"], {"doc_id": "int", "n_chars": "int"})


@query("s_reorganise", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split, source AS dataset, count(*) AS n FROM documents GROUP BY ALL")
def s_reorganise(s, d):
    """Records written by split and dataset, read back with the folders as columns."""
    from sievework.session import shared_folder

    out = shared_folder(s) + "/records"
    rows = table(s, d, "documents").select("doc_id", F.col("source").alias("dataset"), F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train").alias("split"))
    files.write_records(rows.repartition("split", "dataset"), out, by=["split", "dataset"])
    return s.read.parquet(out).groupBy("split", "dataset").agg(F.count(F.lit(1)).alias("n"))


@query("s_jsonl_roundtrip", "SELECT doc_id::VARCHAR AS id, text FROM documents")
def s_jsonl_roundtrip(s, d):
    """Records to JSON lines and back under the text schema."""
    from sievework.session import shared_folder

    out = shared_folder(s) + "/jsonl"
    files.export_jsonl(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"), out)
    return files.read_jsonl(s, out).select("id", "text")


@query("s_upsert_results", """SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1""")
def s_upsert_results(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", "role")
    return files.upsert_results(c.where("turn < 2"), c.where("turn >= 2"), "conv_id", "turn")


@query("p_fallback_id", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id::VARCHAR END, (row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR) AS id FROM documents")
def p_fallback_id(s, d):
    rows = table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string")).alias("id"))
    return files.fallback_id(rows, [F.asc("doc_id")])


@query("p_len_bucket", "SELECT doc_id, (n_chars // 1000)::VARCHAR || 'k' AS bucket FROM documents")
def p_len_bucket(s, d):
    return table(s, d, "documents").select("doc_id", fx.length_bucket(F.col("n_chars")).alias("bucket"))


@query("p_truncated_len", N + "SELECT doc_id, n, least(1024, n) AS kept FROM n")
def p_truncated_len(s, d):
    return counts(s, d).select("doc_id", "n", F.least(F.lit(1024).cast("bigint"), "n").alias("kept"))


@query("p_dataset_filter", "SELECT DISTINCT source FROM documents WHERE source NOT IN ('src1', 'src2') AND NOT contains(source, '7') AND NOT ends_with(source, '9')")
def p_dataset_filter(s, d):
    c = F.col("source")
    return table(s, d, "documents").where(~c.isin("src1", "src2") & ~c.contains("7") & ~c.endswith("9")).select("source").distinct()


@query("p_domain_keep_skip", "SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de') AND source <> 'src3'")
def p_domain_keep_skip(s, d):
    return table(s, d, "documents").where(F.col("lang").isin("fr", "de") & ~F.col("source").isin("src3")).select("doc_id", "lang")


@query("p_has_field", "SELECT count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def p_has_field(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left").where(F.col("quality").isNotNull()).agg(F.count(F.lit(1)).alias("n"))


@query("p_name_parse", """WITH m AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'encoder-' WHEN 1 THEN 'decoder-' WHEN 2 THEN 'dec-from-enc-' WHEN 3 THEN 'enc-from-dec-' ELSE 'other-' END || p_size || 'm' AS name FROM part)
SELECT p_partkey, name, CASE WHEN contains(name, 'dec-from-enc') THEN 'Decoder from Encoder' WHEN contains(name, 'enc-from-dec') THEN 'Encoder from Decoder' WHEN contains(name, 'encoder') THEN 'Encoder' WHEN contains(name, 'decoder') THEN 'Decoder' END AS family,
nullif(regexp_extract(name, '(\\d+[mb])', 1), '') AS size FROM m WHERE name NOT LIKE 'other%'""")
def p_name_parse(s, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("encoder-", "decoder-", "dec-from-enc-", "enc-from-dec-", "other-")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    m = table(s, d, "part").select("p_partkey", F.concat(kind, F.col("p_size").cast("string"), F.lit("m")).alias("name"))
    return m.select("p_partkey", "name", fx.model_family(F.col("name")).alias("family"), fx.model_size(F.col("name")).alias("size")).where(F.col("family").isNotNull())


@query("p_model_key", "SELECT s_suppkey, concat_ws('_', replace(replace(s_name, 'Supplier', 'encoder'), '#', '-'), s_nationkey::VARCHAR) AS model_key FROM supplier")
def p_model_key(s, d):
    return table(s, d, "supplier").select("s_suppkey", F.concat_ws("_", F.replace(F.replace("s_name", F.lit("Supplier"), F.lit("encoder")), F.lit("#"), F.lit("-")), F.col("s_nationkey").cast("string")).alias("model_key"))


@query("p_take_n", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def p_take_n(s, d):
    return table(s, d, "documents").select("doc_id").orderBy("doc_id").limit(25)


# --- group 2: tokens and chunks

@query("t_token_count", N + "SELECT doc_id, n FROM n")
def t_token_count(s, d):
    return counts(s, d).select("doc_id", "n")


VOCAB = f"""WITH w AS (SELECT doc_id, {TOKENS} AS t FROM documents), f AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS tok FROM w),
v AS (SELECT tok, n, (row_number() OVER (ORDER BY n DESC, tok) + 50367)::BIGINT AS tok_id FROM (SELECT tok, count(*) AS n FROM f GROUP BY tok)) """


@query("t_vocab", VOCAB + "SELECT tok, n, tok_id FROM v")
def t_vocab(s, d):
    return tokens.vocabulary(table(s, d, "documents"))


@query("t_encode", VOCAB + "SELECT doc_id, md5(array_to_string(list(tok_id ORDER BY pos), ',')) AS ids_md5, count(*) AS n FROM f JOIN v USING (tok) GROUP BY doc_id")
def t_encode(s, d):
    docs = table(s, d, "documents")
    ids = tokens.encode(docs, tokens.vocabulary(docs))
    return ids.select("doc_id", F.md5(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",").cast("binary")).alias("ids_md5"), F.size("input_ids").cast("bigint").alias("n"))


@query("t_decode_roundtrip", f"SELECT doc_id, array_to_string({TOKENS}, ' ') AS text FROM documents WHERE len({TOKENS}) > 0")
def t_decode_roundtrip(s, d):
    docs = table(s, d, "documents")
    v = tokens.vocabulary(docs)
    ids = tokens.encode(docs, v).withColumn("input_ids", tokens.frame(F.col("input_ids")))
    return tokens.decode(ids, v)


#: Word lengths stand in for ids where only positions matter, so that no vocabulary is needed.
LENGTHS = f"list_transform({TOKENS}, lambda x: length(x)::BIGINT)"


def length_ids(s, d) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "source", F.transform(fx.tokens(F.col("text")), lambda w: F.length(w).cast("bigint")).alias("input_ids"))


@query("t_eos", f"SELECT doc_id, len(list_append({LENGTHS}, 50282))::BIGINT AS n, 50282::BIGINT AS last_id FROM documents")
def t_eos(s, d):
    once = tokens.append_eos(tokens.append_eos(F.col("input_ids")))
    return length_ids(s, d).select("doc_id", F.size(once).cast("bigint").alias("n"), F.element_at(once, -1).alias("last_id"))


@query("t_non_pad", f"SELECT doc_id, len(list_filter({LENGTHS}, lambda x: x <> 5))::BIGINT AS n FROM documents")
def t_non_pad(s, d):
    return length_ids(s, d).select("doc_id", tokens.non_pad(F.col("input_ids"), 5).cast("bigint").alias("n"))


@query("t_fixed_split", N + "SELECT doc_id, unnest(range(0, (n + 125) // 126))::BIGINT AS chunk_no, n FROM n WHERE n > 0")
def t_fixed_split(s, d):
    return tokens.chunk_spans(counts(s, d), ChunkRule(128, 1, 0, False), "doc_id").select("doc_id", "chunk_no", "n")


def plan_sql(c: int, m: int, a: int, backfill: bool, zeroth: bool = False) -> str:
    gone = f"(k = 0 AND n > 0 AND n < {a})" if zeroth else "false"
    short = f"rem < {a if backfill else max(a, m)}"
    lend = f"(k > 0 AND rem > 0 AND rem >= {a} AND rem < {m})" if backfill else "false"
    return f"""WITH n AS (SELECT doc_id, source, {NTOK} AS n FROM documents), q AS (SELECT *, n // {c} AS k, n % {c} AS rem FROM n),
p AS (SELECT *, (CASE WHEN n = 0 OR {gone} THEN 0 WHEN rem = 0 THEN k WHEN k = 0 THEN 1 WHEN {short} THEN k ELSE k + 1 END)::BIGINT AS nc,
(CASE WHEN {lend} THEN {draw_sql("doc_id::VARCHAR")} % ({c} - rem) ELSE 0 END)::BIGINT AS r,
(CASE WHEN {gone} THEN n WHEN k > 0 AND rem > 0 AND {short} THEN rem ELSE 0 END)::BIGINT AS skipped FROM q),
e AS (SELECT *, unnest(range(0, nc))::BIGINT AS i FROM p WHERE nc > 0),
c AS (SELECT doc_id, source, i AS chunk_no, i * {c} - CASE WHEN i = k AND k > 0 THEN r ELSE 0 END AS start,
(CASE WHEN i < k THEN {c} ELSE rem END) + (CASE WHEN i = k AND k > 0 THEN r ELSE 0 END) - (CASE WHEN i = k - 1 AND rem > 0 THEN r ELSE 0 END) AS len FROM e) """


@query("t_chunk_nobackfill", plan_sql(126, 64, 16, False) + "SELECT doc_id, chunk_no, start::BIGINT AS start, len::BIGINT AS len FROM c")
def t_chunk_nobackfill(s, d):
    return tokens.chunk_spans(counts(s, d), ChunkRule(128, 64, 16, False), "doc_id").select("doc_id", "chunk_no", F.col("start").cast("bigint").alias("start"), F.col("len").cast("bigint").alias("len"))


@query("t_chunk_backfill", plan_sql(126, 64, 16, True, True) + "SELECT doc_id, chunk_no, start::BIGINT AS start, len::BIGINT AS len FROM c")
def t_chunk_backfill(s, d):
    return tokens.chunk_spans(counts(s, d), ChunkRule(128, 64, 16, True, True), "doc_id").select("doc_id", "chunk_no", F.col("start").cast("bigint").alias("start"), F.col("len").cast("bigint").alias("len"))


@query("t_frame", plan_sql(126, 64, 16, True) + f""", t AS (SELECT doc_id, {LENGTHS} AS ids FROM documents)
SELECT doc_id, chunk_no, (len + 2)::BIGINT AS len, 50281::BIGINT AS first_id, 50282::BIGINT AS last_id, list_sum(ids[start + 1 : start + len])::BIGINT AS body_sum FROM c JOIN t USING (doc_id)""")
def t_frame(s, d):
    c = tokens.chunk(length_ids(s, d), ChunkRule(128, 64, 16, True), "doc_id")
    total = F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return c.select("doc_id", "chunk_no", F.col("len").cast("bigint").alias("len"), F.element_at("input_ids", 1).alias("first_id"), F.element_at("input_ids", -1).alias("last_id"), (total - 50281 - 50282).alias("body_sum"))


@query("t_chunk_stats", plan_sql(126, 64, 16, True) + """SELECT source, count(*) AS chunks, sum(len)::BIGINT AS written, any_value(s)::BIGINT AS skipped, trunc(quantile_cont(len, 0.5) + 1e-6)::INTEGER AS p50, trunc(quantile_cont(len, 0.99) + 1e-6)::INTEGER AS p99
FROM c JOIN (SELECT source, sum(skipped) AS s FROM p GROUP BY source) USING (source) GROUP BY source""")
def t_chunk_stats(s, d):
    rule, n = ChunkRule(128, 64, 16, True), counts(s, d)
    written = tokens.chunk_spans(n, rule, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.sum("len").cast("bigint").alias("written"), stats.percentiles("len").alias("p"))
    skipped = tokens.plan_chunks(n, rule, "doc_id").groupBy("source").agg(F.sum("skipped").cast("bigint").alias("skipped"))
    return written.join(skipped, "source").select("source", "chunks", "written", "skipped", F.col("p")["50"].alias("p50"), F.col("p")["99"].alias("p99"))


@query("t_frame_checked", plan_sql(126, 64, 16, True) + "SELECT doc_id, chunk_no, (len + 2)::BIGINT AS len FROM c")
def t_frame_checked(s, d):
    rule = ChunkRule(128, 64, 16, True)
    return tokens.checked_frames(tokens.chunk(length_ids(s, d), rule, "doc_id"), rule).select("doc_id", "chunk_no", F.col("len").cast("bigint").alias("len"))


@query("t_truncate", f"SELECT doc_id, list_sum({LENGTHS}[1:100])::BIGINT AS total FROM documents")
def t_truncate(s, d):
    total = F.aggregate(F.slice("input_ids", 1, 100), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return length_ids(s, d).select("doc_id", F.when(F.size("input_ids") > 0, total).alias("total"))  # no words: null, as a sum of none


@query("t_batches", f"SELECT doc_id, rn, batch_no FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '-21'), doc_id) AS rn, ((row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '-21'), doc_id) - 1) // 48)::BIGINT AS batch_no, count(*) OVER () AS total FROM documents) WHERE batch_no < total // 48")
def t_batches(s, d):
    return tokens.batches(table(s, d, "documents").select("doc_id"), "doc_id", 48, 21)


def mask_sql(pos: str) -> str:
    """Whether a place is masked at a rate of 0.3: eight digits of an md5 that four places share."""
    return f"substr(md5(doc_id::VARCHAR || '-' || ({pos} // 4)::VARCHAR), (8 * ({pos} % 4) + 1)::INTEGER, 8) < '{int(0.3 * 2**32):08x}'"


@query("t_mask", f"""WITH f AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, {TOKENS} AS t FROM documents))
SELECT doc_id, count(*) AS n, sum(({mask_sql('pos')})::INTEGER)::BIGINT AS n_masked FROM f GROUP BY doc_id""")
def t_mask(s, d):
    n = table(s, d, "documents").select("doc_id", F.size(fx.tokens(F.col("text"))).alias("n")).where("n > 0")
    masked = F.filter(tokens.mask_flags(F.col("doc_id"), F.col("n"), 0.3), lambda m: m)
    return n.select("doc_id", F.col("n").cast("bigint").alias("n"), F.size(masked).cast("bigint").alias("n_masked"))


@query("t_masked_ids", f"""SELECT doc_id, md5(array_to_string(list_transform({LENGTHS}, lambda x, i: CASE WHEN {mask_sql('(i - 1)')} THEN 50284 ELSE x END), ',')) AS ids_md5 FROM documents""")
def t_masked_ids(s, d):
    ids = tokens.mask_ids(F.col("input_ids"), F.col("doc_id"), 0.3)
    return length_ids(s, d).select("doc_id", F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").cast("binary")).alias("ids_md5"))


# --- group 3: joins

COUNTS3 = """WITH m AS (SELECT source AS dataset, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT source AS dataset, count(*) AS n FROM documents WHERE doc_id % 50 <> 7 AND source <> 'src4' GROUP BY 1),
v AS (SELECT source AS dataset, count(*) AS n FROM documents WHERE doc_id % 50 = 7 GROUP BY 1) """


def by_source(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))


@query("j_audit_left", COUNTS3 + """SELECT dataset, m.n AS main_n, coalesce(t.n, 0) AS train_n, coalesce(v.n, 0) AS valid_n, coalesce(t.n, 0) / greatest(m.n, 1)::DOUBLE AS train_ratio,
abs(coalesce(t.n, 0) / greatest(m.n, 1)::DOUBLE - 0.999::DOUBLE) <= 0.001::DOUBLE + 1e-12::DOUBLE AS ratio_ok, coalesce(t.n, 0) + coalesce(v.n, 0) = m.n AS total_ok FROM m LEFT JOIN t USING (dataset) LEFT JOIN v USING (dataset)""")
def j_audit_left(s, d):
    docs = table(s, d, "documents").select("doc_id", "source")
    k = F.col("doc_id") % 50
    return stats.audit_split(by_source(docs), by_source(docs.where((k != 7) & (F.col("source") != "src4"))), by_source(docs.where(k == 7)))


@query("j_mismatch", COUNTS3 + "SELECT dataset, m.n AS left_n, coalesce(t.n, 0) AS right_n FROM m LEFT JOIN t USING (dataset) WHERE m.n <> coalesce(t.n, 0)")
def j_mismatch(s, d):
    docs = table(s, d, "documents").select("doc_id", "source")
    return stats.mismatches(by_source(docs), by_source(docs.where((F.col("doc_id") % 50 != 7) & (F.col("source") != "src4"))), "dataset")


@query("j_pending_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j_pending_anti(s, d):
    return stats.pending(table(s, d, "documents").select("doc_id", "source"), table(s, d, "labels"), "doc_id")


@query("j_chosen_semi", "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM (SELECT source FROM documents GROUP BY source ORDER BY md5(source || '-5'), source LIMIT 4))")
def j_chosen_semi(s, d):
    docs = table(s, d, "documents").select("doc_id", "source")
    return docs.join(sampling.folder_subset(docs.select("source").distinct(), 4, 5, "source"), "source", "left_semi")


@query("j_fanout", "SELECT doc_id, unnest(range(1, 2 + doc_id % 3))::BIGINT AS copy_id FROM documents")
def j_fanout(s, d):
    docs = table(s, d, "documents").select("doc_id")
    copies = docs.select("doc_id", (F.col("doc_id") % 3 + 1).alias("copies"))
    return docs.join(copies, "doc_id").select("doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy_id"))


@query("j_range_index", """WITH r AS (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS lo, sum(n_chars) OVER (ORDER BY doc_id) AS hi FROM documents), g AS (SELECT unnest(range(0, (SELECT sum(n_chars) FROM documents)::BIGINT, 10007))::BIGINT AS spot)
SELECT spot, doc_id, (spot - lo)::BIGINT AS offset_in FROM g JOIN r ON spot >= lo AND spot < hi""")
def j_range_index(s, d):
    r = sampling.running_total(table(s, d, "documents").select("doc_id", "n_chars"), [F.asc("doc_id")], F.col("n_chars"), "hi").withColumn("lo", F.col("hi") - F.col("n_chars"))
    total = table(s, d, "documents").agg(F.coalesce(F.sum("n_chars"), F.lit(0))).first()[0]
    g = s.range(0, total, 10007).withColumnRenamed("id", "spot")
    return relational.range_join(g, r, "spot", "lo", "hi", 4096).select("spot", "doc_id", (F.col("spot") - F.col("lo")).alias("offset_in"))


@query("j_registry_broadcast", "SELECT doc_id, 'org/' || source AS repo FROM documents")
def j_registry_broadcast(s, d):
    docs = table(s, d, "documents").select("doc_id", "source")
    reg = docs.select("source").distinct().withColumn("repo", F.concat(F.lit("org/"), "source"))
    return docs.join(reg, "source").select("doc_id", "repo")


@query("j_pad_dimension", "SELECT position, size, coalesce(v, 0)::DOUBLE AS v FROM (VALUES (0, '5-LOW'), (1, '4-NOT SPECIFIED'), (2, '3-MEDIUM'), (3, 'NONE')) AS t(position, size) LEFT JOIN (SELECT o_orderpriority AS size, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY 1) USING (size)")
def j_pad_dimension(s, d):
    from sievework.operators.bias import pad_sizes

    seen = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("size")).agg(F.round(F.avg("o_totalprice"), 4).alias("v"))
    return pad_sizes(seen, ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "NONE"], "v")


# --- group 4: aggregates

@query("a_token_totals", N + "SELECT sum(n)::BIGINT AS num_tokens, sum(least(n, 1024))::BIGINT AS num_truncated_tokens FROM n")
def a_token_totals(s, d):
    return counts(s, d).agg(F.sum("n").cast("bigint").alias("num_tokens"), F.sum(F.least("n", F.lit(1024))).cast("bigint").alias("num_truncated_tokens"))


@query("a_percentiles", N + "SELECT source, " + ", ".join(f"trunc(quantile_cont(n, {p / 100}) + 1e-6)::INTEGER AS p{p}" for p in stats.PERCENTS) + " FROM n GROUP BY source")
def a_percentiles(s, d):
    p = counts(s, d).groupBy("source").agg(stats.percentiles("n").alias("p"))
    return p.select("source", *[F.col("p")[str(k)].alias(f"p{k}") for k in stats.PERCENTS])


@query("a_histogram", "SELECT (n_chars // 1000)::VARCHAR || 'k' AS bucket, count(*) AS rows, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS members_md5 FROM documents GROUP BY 1")
def a_histogram(s, d):
    h = stats.length_histogram(table(s, d, "documents").select("doc_id", "n_chars"), F.col("n_chars"), "doc_id")
    return h.select("bucket", "rows", F.md5(F.array_join(F.transform("members", lambda x: x.cast("string")), ",").cast("binary")).alias("members_md5"))


@query("a_histogram_rows", "SELECT (n_chars // 1000)::VARCHAR || 'k' AS bucket, doc_id FROM documents")
def a_histogram_rows(s, d):
    return stats.histogram_members(table(s, d, "documents").select("doc_id", "n_chars"), F.col("n_chars"), "doc_id")


@query("a_same_totals", COUNTS3 + "SELECT dataset, coalesce(m.n, 0) AS left_n, coalesce(t.n, 0) AS right_n, coalesce(m.n, 0) = coalesce(t.n, 0) AS same FROM m FULL JOIN t USING (dataset)")
def a_same_totals(s, d):
    docs = table(s, d, "documents").select("doc_id", "source")
    return stats.same_totals(by_source(docs), by_source(docs.where((F.col("doc_id") % 50 != 7) & (F.col("source") != "src4"))), "dataset")


@query("p_resume", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE rn > 300")
def p_resume(s, d):
    return files.resume_from(table(s, d, "documents").select("doc_id", "lang"), [F.asc("doc_id")], 300)


@query("a_manifest_count", "SELECT source, count(*) AS instances FROM documents GROUP BY source")
def a_manifest_count(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("instances"))


@query("a_rollup_stats", "SELECT lang AS dataset, count(*) AS docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY ROLLUP (lang)")
def a_rollup_stats(s, d):
    per = table(s, d, "documents").groupBy(F.col("lang").alias("dataset"), "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("n_chars")).drop("source")
    return stats.merge_stats(per)


@query("a_grouping_check", "SELECT source, count(*) AS n, grouping(source)::INTEGER AS is_total FROM documents GROUP BY GROUPING SETS ((), (source))")
def a_grouping_check(s, d):
    t = table(s, d, "documents")
    return t.rollup("source").agg(F.count(F.lit(1)).alias("n"), F.grouping("source").cast("int").alias("is_total"))


@query("a_dataset_size", "SELECT source AS dataset, sum(n_chars) / 1e9::DOUBLE AS size_gb, count(*) AS instances FROM documents GROUP BY source")
def a_dataset_size(s, d):
    return table(s, d, "documents").groupBy(F.col("source").alias("dataset")).agg((F.sum("n_chars") / F.lit(1e9)).alias("size_gb"), F.count(F.lit(1)).alias("instances"))


@query("a_describe", "SELECT count(n_chars) AS n, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS std, min(n_chars) AS least, quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.5) AS q50, quantile_cont(n_chars, 0.75) AS q75, max(n_chars) AS greatest FROM documents")
def a_describe(s, d):
    return stats.describe(table(s, d, "documents"), "n_chars").withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("a_mixture_budget", "WITH w AS (SELECT lang AS domain, count(*)::DOUBLE AS pct FROM documents WHERE lang <> 'es' GROUP BY 1) SELECT domain, round(pct / sum(pct) OVER () * 100, 6) AS pct, floor(100000 * (pct / sum(pct) OVER () * 100) / 100 + 1e-9::DOUBLE)::BIGINT AS budget FROM w")
def a_mixture_budget(s, d):
    w = table(s, d, "documents").groupBy(F.col("lang").alias("domain")).agg(F.count(F.lit(1)).cast("double").alias("pct"))
    return sampling.mixture_budget(w, 100_000, ["es"]).withColumn("pct", F.round("pct", 6))


@query("a_shares", "SELECT lang, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM documents GROUP BY lang")
def a_shares(s, d):
    from sievework.operators.bias import shares

    return shares(table(s, d, "documents"), "lang")


@query("a_baseline", "SELECT round(sum(p * p), 9) AS baseline FROM (SELECT count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM documents GROUP BY lang)")
def a_baseline(s, d):
    from sievework.operators.bias import baseline

    return baseline(table(s, d, "documents"), "lang").withColumn("baseline", F.round("baseline", 9))


@query("a_pivot", "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de FROM documents GROUP BY source")
def a_pivot(s, d):
    p = table(s, d, "documents").groupBy("source").pivot("lang", ["en", "fr", "de"]).agg(F.count(F.lit(1)))
    return p.select("source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("en", "fr", "de")])


@query("a_summary", N + ", f AS (SELECT source, sum(n)::BIGINT AS tokens FROM n GROUP BY source) SELECT sum(tokens)::BIGINT AS total_tokens, count(DISTINCT source) AS num_unique_folders, count(*) AS num_total_folders, string_agg(source, ',' ORDER BY source) AS folders FROM f")
def a_summary(s, d):
    return folders(s, d).agg(F.sum("tokens").cast("bigint").alias("total_tokens"), F.count_distinct("source").alias("num_unique_folders"), F.count(F.lit(1)).alias("num_total_folders"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("folders"))


@query("a_best_per_group", "SELECT c_mktsegment, max(c_acctbal) AS best, (list(c_name ORDER BY c_acctbal DESC, c_name DESC))[1] AS name, count_if(c_acctbal > 0) AS positive FROM customer GROUP BY 1")
def a_best_per_group(s, d):
    return table(s, d, "customer").groupBy("c_mktsegment").agg(F.max(F.struct("c_acctbal", "c_name")).alias("m"), F.count_if(F.col("c_acctbal") > 0).alias("positive")).select("c_mktsegment", F.col("m.c_acctbal").alias("best"), F.col("m.c_name").alias("name"), "positive")


# --- group 5: windows, order, sets

@query("w_ordinal", "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn FROM documents")
def w_ordinal(s, d):
    return sampling.ordinal(table(s, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "rn")


@query("w_permutation", f"SELECT doc_id, row_number() OVER (ORDER BY {PERMUTED}, doc_id) AS rn FROM documents")
def w_permutation(s, d):
    return sampling.permute(table(s, d, "documents").select("doc_id"), "doc_id", SEED)


@query("w_running_total", f"SELECT doc_id, (sum(n_chars) OVER (ORDER BY {PERMUTED}, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS cum FROM documents")
def w_running_total(s, d):
    return sampling.stop_before(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 2**62, SEED).select("doc_id", "cum")


@query("w_group_budget", f"SELECT source, doc_id, cum FROM (SELECT source, doc_id, (sum(n_chars) OVER (PARTITION BY source ORDER BY {PERMUTED}, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS cum FROM documents) WHERE cum <= 20000")
def w_group_budget(s, d):
    return sampling.group_stop_before(table(s, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 20_000, SEED).select("source", "doc_id", "cum")


@query("w_latest", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def w_latest(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", F.col("m.event_id").alias("event_id"))


@query("w_rank_in_topk", "SELECT event_type, event_id, r::INTEGER AS rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 10")
def w_rank_in_topk(s, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(s, d, "events").select("event_type", "event_id", F.row_number().over(w).alias("rank")).where("rank <= 10")


@query("w_first_last", "SELECT DISTINCT source, first_value(doc_id) OVER w AS first_id, last_value(doc_id) OVER w AS last_id FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def w_first_last(s, d):
    o = F.struct("n_chars", "doc_id")
    return table(s, d, "documents").groupBy("source").agg(F.min(o)["doc_id"].alias("first_id"), F.max(o)["doc_id"].alias("last_id"))


@query("o_numeric_suffix", "SELECT source, try_cast(nullif(regexp_extract(source, '(\\d+)$', 1), '') AS BIGINT) AS suffix FROM (SELECT DISTINCT source FROM documents)")
def o_numeric_suffix(s, d):
    return table(s, d, "documents").select("source").distinct().select("source", relational.numeric_suffix(F.col("source")).alias("suffix")).orderBy(F.asc_nulls_last("suffix"))


@query("o_category", "SELECT o_orderkey, coalesce(nullif(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority), 0), 4)::INTEGER AS place FROM orders")
def o_category(s, d):
    return table(s, d, "orders").select("o_orderkey", relational.category_order(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"]).alias("place"))


@query("o_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def o_topk(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("o_offset", "SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY source OFFSET 5")
def o_offset(s, d):
    return table(s, d, "documents").select("source").distinct().orderBy("source").offset(5)


@query("u_union", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def u_union(s, d):
    return table(s, d, "nation").select(F.col("n_name").alias("name")).unionByName(table(s, d, "region").select(F.col("r_name").alias("name")))


@query("u_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u_except(s, d):
    return table(s, d, "documents").select("doc_id").subtract(table(s, d, "labels").select("doc_id"))


@query("u_distinct", "SELECT DISTINCT lang, source FROM documents")
def u_distinct(s, d):
    return table(s, d, "documents").select("lang", "source").distinct()


@query("u_array_union", "SELECT conv_id, array_to_string(list_sort(list_distinct(flatten(list([role, 'all'])))), ',') AS roles FROM conversations GROUP BY conv_id")
def u_array_union(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("role"), F.array(F.lit("all")))), ",").alias("roles"))


# --- group 6: sampling

STOP = f"SELECT doc_id, n, (sum(n) OVER (ORDER BY {PERMUTED}, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS cum FROM n"


@query("m_rows_stop_after", N + f"SELECT doc_id, n, cum FROM ({STOP}) WHERE cum - n < 20000")
def m_rows_stop_after(s, d):
    return sampling.stop_after(counts(s, d).select("doc_id", "n"), "doc_id", "n", 20_000, SEED)


@query("m_two_level", N + f"SELECT doc_id, n, cum FROM ({STOP}) WHERE cum - n < 20000")
def m_two_level(s, d):
    """The rule of m_rows_stop_after by the other way to a running total: parts of a sort by range, not digits of the key."""
    rows = counts(s, d).select("doc_id", "n").withColumn("k", fx.order_key(F.col("doc_id"), F.lit(SEED)))
    return sampling.running_total(rows, [F.asc("k"), F.asc("doc_id")], F.col("n"), "cum").where(F.col("cum") - F.col("n") < 20_000).select("doc_id", "n", "cum")


@query("m_rows_stop_before", N + f"SELECT doc_id, n, cum FROM ({STOP}) WHERE cum <= 20000")
def m_rows_stop_before(s, d):
    return sampling.stop_before(counts(s, d).select("doc_id", "n"), "doc_id", "n", 20_000, SEED)


FOLD = N + ", f AS (SELECT source, sum(n)::BIGINT AS tokens FROM n GROUP BY source), g AS (SELECT *, (sum(tokens) OVER (ORDER BY md5(source || '-42'), source ROWS UNBOUNDED PRECEDING))::BIGINT AS cum FROM f) "


@query("m_folders", FOLD + "SELECT source, tokens, cum FROM g WHERE cum - tokens < 100000")
def m_folders(s, d):
    return sampling.sample_folders(folders(s, d).select("source", "tokens"), 100_000, SEED, "source")


@query("m_upsample", FOLD + f""", tot AS (SELECT sum(tokens)::BIGINT AS t, count(*) AS k, min(tokens) AS least FROM f), goal AS (SELECT t + 50000 AS target FROM tot),
pool AS (SELECT source, tokens, row_number() OVER (ORDER BY source) - 1 AS pick FROM f), dr AS (SELECT i, {draw_sql("'42-' || i::VARCHAR")} % (SELECT k FROM tot) AS pick FROM (SELECT unnest(range(1, 1 + (SELECT ceil(50000.0 / least) FROM tot)::BIGINT)) AS i)),
c AS (SELECT i, source, tokens, sum(tokens) OVER (ORDER BY i) AS cum FROM dr JOIN pool USING (pick))
SELECT source, tokens, 0::BIGINT AS copy_id FROM f UNION ALL SELECT source, tokens, i::BIGINT FROM c WHERE cum - tokens < 50000""")
def m_upsample(s, d):
    f = folders(s, d).select("source", "tokens")
    return sampling.resample_folders(f, f.agg(F.sum("tokens")).first()[0] + 50_000, SEED, "source")


@query("m_split_one_folder", N + f""", b AS (SELECT floor(sum(n) * 0.005::DOUBLE)::BIGINT AS budget FROM n), ch AS (SELECT source FROM (SELECT DISTINCT source FROM n) ORDER BY md5(source || '-42'), source LIMIT 1),
v AS (SELECT doc_id FROM (SELECT doc_id, sum(n) OVER (ORDER BY {PERMUTED}, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM n WHERE source = (SELECT source FROM ch)) WHERE cum <= (SELECT budget FROM b))
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM v) THEN 'validation' ELSE 'train' END AS split FROM n""")
def m_split_one_folder(s, d):
    return sampling.split_one_folder(counts(s, d), SEED, 0.005, "doc_id", "n", "source").select("doc_id", "split")


@query("m_split_unseen", FOLD + f""", r AS (SELECT * FROM n WHERE source NOT IN (SELECT source FROM g WHERE cum - tokens < 100000))
SELECT doc_id, source, n FROM (SELECT *, sum(n) OVER (ORDER BY md5(source || '-42'), source, {PERMUTED}, doc_id ROWS UNBOUNDED PRECEDING) AS c FROM r) WHERE c <= 30000""")
def m_split_unseen(s, d):
    rows = counts(s, d)
    return sampling.split_unseen(rows, sampling.sample_folders(folders(s, d).select("source", "tokens"), 100_000, SEED, "source"), 30_000, SEED, "doc_id", "n", "source").select("doc_id", "source", "n")


@query("m_mixture_epochs", f"""WITH n AS (SELECT doc_id, lang AS domain, {NTOK} AS tokens FROM documents), b AS (SELECT domain, 150000::BIGINT AS budget FROM (VALUES ('fr'), ('de')) t(domain)),
tot AS (SELECT domain, sum(tokens) AS total FROM n WHERE tokens > 0 GROUP BY domain), e AS (SELECT domain, budget, total, unnest(range(0, ceil(budget / total)::BIGINT))::BIGINT AS epoch FROM tot JOIN b USING (domain)),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain ORDER BY {PERMUTED}, doc_id ROWS UNBOUNDED PRECEDING) - tokens AS bef FROM n WHERE tokens > 0)
SELECT doc_id, domain, tokens, epoch FROM c JOIN e USING (domain) WHERE epoch * total + bef < budget""")
def m_mixture_epochs(s, d):
    rows = table(s, d, "documents").select("doc_id", F.col("lang").alias("domain"), F.size(fx.tokens(F.col("text"))).cast("bigint").alias("tokens"))
    budgets = s.createDataFrame([("fr", 150_000), ("de", 150_000)], "domain string, budget bigint")
    return sampling.mixture_sample(rows, budgets, SEED, "doc_id")


@query("m_folder_subset", "SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY md5(source || '-42'), source LIMIT 7")
def m_folder_subset(s, d):
    return sampling.folder_subset(table(s, d, "documents").select("source").distinct(), 7, SEED, "source")


@query("m_test_split", "SELECT doc_id, CASE WHEN rn <= 100 THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '-12'), doc_id) AS rn FROM documents) WHERE rn <= 600")
def m_test_split(s, d):
    return sampling.test_split(table(s, d, "documents").select("doc_id"), "doc_id", 100, 12, 500).select("doc_id", "split")


@query("m_no_duplicates", "SELECT doc_id, (row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) - 1)::INTEGER AS batch_offset FROM documents")
def m_no_duplicates(s, d):
    return sampling.no_duplicate_batches(table(s, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h")), "h", "doc_id").select("doc_id", "batch_offset")


# --- subwords: no SQL, tests hold them against the tokenizer itself

@query("t_subword_encode")
def t_subword_encode(s, d):
    """Every document's ids by a byte-level vocabulary, every frequent piece encoded once."""
    coded = subwords.encode(table(s, d, "documents").select("doc_id", "text"), "byte_bpe_50k")
    return coded.select("doc_id", F.size("input_ids").cast("bigint").alias("n"), F.md5(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",").cast("binary")).alias("ids_md5"))


@query("t_subword_rechunk")
def t_subword_rechunk(s, d):
    """Chunks of 512 ids, each encoded anew where its text does not begin with a space; totals by document."""
    chunks = tokens.chunk(subwords.encode(table(s, d, "documents").select("doc_id", "text"), "byte_bpe_50k"), ChunkRule(512, 100, 20), "doc_id")
    return subwords.reencode(chunks, "byte_bpe_50k", 512).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("len").alias("tokens"), F.sum("lost").alias("lost"))


# --- folder trees, sketches, batches, export

LEAF = "concat_ws('/', coalesce(lang, 'none'), coalesce(source, 'none'), 'b' || doc_id % 3)"


@query("a_tree_stats", f"""WITH RECURSIVE leaf AS (SELECT {LEAF} AS path, count(*) AS docs, sum(n_chars) AS chars, any_value(NOT (lang = 'de' AND source = 'src3' AND doc_id % 3 = 1)) AS there FROM documents GROUP BY 1),
up AS (SELECT path, docs, chars, there FROM leaf UNION ALL SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END, docs, chars, there FROM up WHERE path <> '')
SELECT path, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END::INTEGER AS depth, count(*) AS leaves, count(*) FILTER (there) AS present, bool_and(there) AS complete,
CASE WHEN bool_and(there) THEN sum(docs)::BIGINT ELSE -1 END AS docs, CASE WHEN bool_and(there) THEN sum(chars)::BIGINT ELSE -1 END AS chars FROM up GROUP BY path""")
def a_tree_stats(s, d):
    """Totals of language / source / part, one part of which is not there yet; -1 where totals are not complete."""
    path = F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")), F.concat(F.lit("b"), F.col("doc_id") % 3))
    docs = table(s, d, "documents").select(path.alias("path"), "n_chars")
    there = docs.where("path <> 'de/src3/b1'").groupBy("path").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))
    return tree.tree_totals(docs.select("path"), there).fillna(-1, ["docs", "chars"])


@query("a_sketch_bounds", "SELECT event_type, count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS total, TRUE AS items_ok, TRUE AS median_ok FROM events GROUP BY 1 UNION ALL SELECT 'all', count(*), sum(floor(value)::BIGINT)::BIGINT, TRUE, TRUE FROM events")
def a_sketch_bounds(s, d):
    """Sketches of each folder and of their union, held against the exact counts and ranks."""
    e = table(s, d, "events").select("event_type", "user_id", F.floor("value").alias("value"))
    each = tree.folder_sketches(e, "event_type", "user_id", "value")
    said = tree.read_sketches(each.unionByName(tree.merge_sketches(each, [F.lit("all").alias("event_type")])), [50])
    true = e.unionByName(e.withColumn("event_type", F.lit("all"))).join(said, "event_type").groupBy("event_type", "n", "total", "distinct").agg(
        F.count_distinct("user_id").alias("exact"), F.avg((F.col("value") < F.col("percentiles")["50"]).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("percentiles")["50"]).cast("double")).alias("upto"))
    return true.select("event_type", "n", "total", (F.abs(F.col("distinct") / F.col("exact") - 1) < 0.05).alias("items_ok"), ((F.col("below") < 0.53) & (F.col("upto") > 0.47)).alias("median_ok"))


@query("m_warm_up", f"""WITH RECURSIVE r AS (SELECT doc_id, row_number() OVER (ORDER BY {PERMUTED}, doc_id) - 1 AS place_no FROM documents), b AS (SELECT 0::BIGINT AS batch_no, 0::BIGINT AS lo, 2::BIGINT AS size
UNION ALL SELECT batch_no + 1, lo + size, CASE WHEN lo + size < 150 THEN least(16, greatest(2, 16 * (lo + size) // 150)) ELSE 16 END FROM b WHERE lo + size < (SELECT count(*) FROM documents))
SELECT doc_id, batch_no, size::INTEGER AS batch_size FROM r JOIN b ON place_no >= lo AND place_no < lo + size""")
def m_warm_up(s, d):
    """Batches that grow from 2 to 16 rows over the first 150 rows."""
    return batching.warm_up_batches(table(s, d, "documents").select("doc_id"), "doc_id", SEED, 150, 2, 16).select("doc_id", "batch_no", "batch_size")


@query("m_distinct_batches", f"""WITH c AS (SELECT text, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1), o AS (SELECT doc_id, row_number() OVER (ORDER BY coalesce(copies, 1) DESC, md5(concat_ws('-', text, '{SEED}')), text, doc_id) - 1 AS place_no, count(*) OVER () // 4 AS batches FROM documents LEFT JOIN c USING (text))
SELECT doc_id, (place_no % batches)::BIGINT AS batch_no FROM o WHERE place_no < batches * 4""")
def m_distinct_batches(s, d):
    """Full batches of four documents, no text twice in one."""
    return batching.distinct_batches(table(s, d, "documents").select("doc_id", "text"), "text", "doc_id", 4, SEED).select("doc_id", "batch_no")


@query("s_block_shuffle", f"""WITH b AS (SELECT doc_id // 16 AS block, (row_number() OVER (ORDER BY md5((doc_id // 16)::VARCHAR || '-{SEED}')) - 1) // 4 AS g FROM documents GROUP BY 1)
SELECT doc_id, row_number() OVER (ORDER BY g, md5(block::VARCHAR || '-' || doc_id::VARCHAR || '-{SEED}')) AS place FROM documents JOIN b ON block = doc_id // 16""")
def s_block_shuffle(s, d):
    """A shuffled read: blocks of 16 ids in random order, the rows of four blocks mixed."""
    rows = table(s, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 16).alias("block"))
    return batching.block_shuffle(rows, "block", "doc_id", SEED, 4).select("doc_id", "place")


@query("s_export_manifest", "SELECT lang AS folder, count(*) AS rows, count(*) AS found_rows, TRUE AS same FROM documents GROUP BY 1")
def s_export_manifest(s, d):
    """Documents exported by language in two commits, the second of which finds one folder done."""
    rows, target = table(s, d, "documents").select("doc_id", "lang", "source"), shared_folder(s)
    export.export_folders(rows.where("lang = 'de'"), target, "lang", "first")
    export.export_folders(rows, target, "lang", "second")
    return export.verify(s, target, rows.schema, "lang")


@query("o_numeric_suffix_last", "SELECT source, (row_number() OVER (ORDER BY try_cast(nullif(regexp_extract(source, '(\\d+)$', 1), '') AS BIGINT) DESC NULLS LAST, source))::INTEGER AS place FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def o_numeric_suffix_last(s, d):
    """The reverse order of the folders: by the number at the end, the greatest first; one row a folder."""
    names = table(s, d, "documents").where("source IS NOT NULL").select("source").distinct()
    return sampling.ordinal(names, [F.desc_nulls_last(relational.numeric_suffix(F.col("source"))), F.asc("source")], "place").select("source", F.col("place").cast("int").alias("place"))


@query("p_other_direction", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'decoder-' WHEN 1 THEN 'encoder-' WHEN 2 THEN 'enc-from-dec-' WHEN 3 THEN 'dec-from-enc-' ELSE 'other-' END || p_size || 'm' AS name FROM part")
def p_other_direction(s, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("encoder-", "decoder-", "dec-from-enc-", "enc-from-dec-", "other-")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", fx.other_direction(F.concat(kind, F.col("p_size").cast("string"), F.lit("m"))).alias("name"))


@query("f_json_write", "SELECT doc_id, json_object('id', doc_id, 'lang', coalesce(lang, ''), 'n', n_chars)::VARCHAR AS line FROM documents")
def f_json_write(s, d):
    line = F.to_json(F.struct(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("n_chars").alias("n")))
    return table(s, d, "documents").select("doc_id", line.alias("line"))


@query("f_clock", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS clock FROM events")
def f_clock(s, d):
    return table(s, d, "events").select("event_id", fx.clock(F.col("ts")).alias("clock"))


@query("p_shard_ids", "SELECT doc_id, (p // 30)::BIGINT AS shard, ((p // 30) * 30 + p % 30)::BIGINT::VARCHAR AS id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents)")
def p_shard_ids(s, d):
    """Ids from the shard's number and the place in it, in shards of 30 rows."""
    rows = sampling.ordinal(table(s, d, "documents").select("doc_id"), [F.asc("doc_id")], "rn").select("doc_id", F.floor((F.col("rn") - 1) / 30).alias("shard"), ((F.col("rn") - 1) % 30).alias("place"))
    return files.shard_ids(rows, "shard", "place", 30).select("doc_id", "shard", "id")
