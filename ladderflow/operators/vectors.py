"""Similarity of embeddings, and the cache that answers by it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, as doubles, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_similar(queries: DataFrame, data: DataFrame, k: int, query_rows: int = 4096, data_rows: int = 16384) -> DataFrame:
    """The k most similar other vectors of each query (q, x, sim, rank), ties to the smaller id. A stated query set against
    all rows: both are dealt out in blocks of a bounded size, each pair of blocks is one task, and the winners are merged."""
    n_q, n_x = (max(1, -(-df.count() // size)) for df, size in ((queries, query_rows), (data, data_rows)))
    part = lambda df, n: df.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda e: e.cast("double")).alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("own"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = part(queries, n_q).withColumnRenamed("own", "qb").withColumn("xb", every(n_x))
    right = part(data, n_x).withColumnRenamed("own", "xb").withColumn("qb", every(n_q))

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        q, x, sims = [], [], []
        if a.num_rows and b.num_rows:
            ids = b.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, points = ids[order], np.array(b.column("v").to_pylist())[order]
            for i, one in zip(a.column("id").to_pylist(), np.array(a.column("v").to_pylist()), strict=True):
                sim = np.floor((points @ one) * 1e4 + 0.5) / 1e4
                best = np.flatnonzero(sim >= np.partition(sim, -min(len(sim), k + 1))[-min(len(sim), k + 1)])
                best = best[ids[best] != i]
                best = best[np.argsort(-sim[best], kind="stable")][:k]
                q += [i] * len(best)
                x += ids[best].tolist()
                sims += sim[best].tolist()
        return pa.table({"q": pa.array(q, pa.int64()), "x": pa.array(x, pa.int64()), "sim": pa.array(sims, pa.float64())})

    scored = left.groupBy("qb", "xb").cogroup(right.groupBy("qb", "xb")).applyInArrow(solve, "q long, x long, sim double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "x"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def cached_answer(queries: DataFrame, cache: DataFrame, least: float, similar=top_similar) -> DataFrame:
    """for each query (vec_id, h, embedding) the cached row of the same hash, else the most similar one with at least the
    similarity. similar: the exact search, or similarity_index.indexed_top."""
    exact = cache.groupBy("h").agg(F.min("vec_id").alias("hit"))
    known = queries.join(exact, "h", "left").select("vec_id", "embedding", "hit")
    near = similar(known.where("hit is null"), cache, 1).where(F.col("sim") >= least).select(F.col("q").alias("vec_id"), "x")
    rows = known.join(near, "vec_id", "left")
    kind = F.when(F.col("hit").isNotNull(), "exact").when(F.col("x").isNotNull(), "semantic").otherwise("miss")
    return rows.select(F.col("vec_id").alias("q"), F.coalesce("hit", "x").alias("answer"), kind.alias("kind"))
