"""Embedding operators of retrieval evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import stored


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero (F16)."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def mean_pool(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dim, value): mean of the vectors of a group (F15); one row for each dimension, pre-aggregated."""
    return vectors.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def weighted_pool(vectors: DataFrame, group: str, vector: str, weight: Column) -> DataFrame:
    """As mean_pool, each vector with its weight."""
    flat = vectors.select(group, weight.cast("double").alias("w"), F.posexplode(vector).alias("dim", "x"))
    return flat.groupBy(group, "dim").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("value"))


def last_pool(vectors: DataFrame, group: str, order: str) -> DataFrame:
    """The last row of each group by `order`."""
    return vectors.groupBy(group).agg(F.max(F.struct(F.col(order).alias("__o"), F.struct(*[F.col(c).alias(c) for c in vectors.columns if c != group]).alias("r"))).alias("m")).select(group, "m.r.*")


def last_token(vectors: Column, mask: Column) -> Column:
    """Of a row's token vectors the last one that its mask (1: a token, 0: padding) keeps; null if there is none."""
    return F.try_element_at(vectors, F.nullif(F.array_max(F.transform(mask, lambda m, i: F.when(m == 1, i + 1).otherwise(0))), F.lit(0)))


#: Rows packed together, and queries that are broadcast at once.
BLOCK, QUERIES = 4096, 1024


def cosine_top_k(vectors: DataFrame, key: str, vector: str, is_query: Column, k: int) -> DataFrame:
    """(query_id, <key>, sim, rank): each query's k nearest other rows by cosine, rounded to nine digits, ties to the smaller key (F16).

    Rows are packed into blocks of about BLOCK, one binary row each; a block of queries is broadcast, multiplied with
    every block of rows at once, and only k rows of each are sent on.  Rows with a null key or vector, and vectors of
    length zero, take no part; all vectors have one width.
    """
    spark = vectors.sparkSession
    x = F.transform(vector, lambda e: e.cast("double"))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), x.alias("v"), is_query.alias("q"))
    rows = rows.where(F.exists("v", lambda e: e != 0))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()

    def pack(by, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(list(pdf["v"]), np.float64)
        return pd.DataFrame([{"ids": pdf["id"].to_numpy(np.int64).tobytes(), "m": (m / np.linalg.norm(m, axis=1, keepdims=True)).tobytes()}])

    blocks = -(-size.n // BLOCK) or 1
    packed = stored(rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b")).applyInPandas(pack, "ids binary, m binary"), "vectors")

    def best(shared):
        def run(batches):
            ids, q = shared.value
            for pdf in batches:
                for r in pdf.itertuples():
                    own, m = np.frombuffer(r.ids, np.int64), np.frombuffer(r.m, np.float64).reshape(-1, q.shape[1])
                    sim = np.round(q @ m.T, 9)
                    sim[ids[:, None] == own] = -2.0
                    at = np.lexsort((np.broadcast_to(own, sim.shape), -sim), axis=1)[:, :k]
                    out = pd.DataFrame({"query_id": np.repeat(ids, at.shape[1]), key: own[at].ravel(), "sim": np.take_along_axis(sim, at, axis=1).ravel()})
                    yield out[out["sim"] >= -1.5]

        return run

    schema, out = f"query_id long, {key} long, sim double", None
    turns = -(-size.q // QUERIES)
    for t in range(turns):
        got = rows.where("q").where(F.pmod(F.xxhash64("id", F.lit("query")), F.lit(turns)) == t).select("id", "v").orderBy("id").collect()  # about QUERIES rows
        if got:
            q = np.array([r.v for r in got], np.float64)
            part = packed.mapInPandas(best(spark.sparkContext.broadcast((np.array([r.id for r in got], np.int64), q / np.linalg.norm(q, axis=1, keepdims=True)))), schema)
            out = part if out is None else out.unionByName(part)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), key))).where(F.col("rank") <= k)


def triplet_accuracy(triplets: DataFrame, anchor: str, positive: str, negative: str) -> DataFrame:
    """Share of triplets whose positive is nearer than its negative."""
    right = cosine(F.col(anchor), F.col(positive)) > cosine(F.col(anchor), F.col(negative))
    return triplets.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(right.cast("double")), F.lit(0.0)).alias("accuracy"))


def in_batch_loss(pairs: DataFrame, batch: str, key: str, query: str, positive: str, scale: float = 20.0) -> DataFrame:
    """(batch, loss): mean negative log-softmax of each query's own positive among its batch's positives (F16)."""
    q = pairs.select(batch, F.col(key).alias("__q"), F.col(query).alias("__a"))
    p = pairs.select(batch, F.col(key).alias("__p"), F.col(positive).alias("__b"))
    s = q.join(p, batch).select(batch, "__q", "__p", (cosine(F.col("__a"), F.col("__b")) * scale).alias("s"))
    w = Window.partitionBy(batch, "__q")
    soft = s.withColumn("top", F.max("s").over(w)).withColumn("z", F.sum(F.exp(F.col("s") - F.col("top"))).over(w))
    return soft.where(F.col("__q") == F.col("__p")).groupBy(batch).agg(F.avg(F.log("z") + F.col("top") - F.col("s")).alias("loss"))
