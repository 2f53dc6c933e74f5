"""Exact top-k inner-product search: a Voronoi kNN join.

Pivots split queries and data into Voronoi cells. One summary row for each cell (its radius and its smallest distances
to the pivot) gives, for every group of queries, a lower bound of the k-th best score; a data row goes to a group only
if the cell bounds allow it to reach that score. A group is solved in (query block, data block) pairs of bounded size, one
task each, and the block winners are merged.

For x in a cell with pivot s at distance d, and q in a cell with pivot p, radius R and longest query N:
``p.s - R|s| - N d <= q.x <= p.s + R|s| + N d`` (Cauchy-Schwarz, twice).

The number of pivots follows the table (the root of its rows, between 64 and ``most_pivots``), and there is at most one
group for each pivot. Only the pivots, the cell summaries (``k + 1`` numbers each) and one number for each pair of group
and pivot come to the driver: all bounded by ``most_pivots``.

Scores are exact integers: products below 2**52 in floating point, larger ones in 64-bit integers. A component or a score
that no 64-bit integer holds is an error, never a wrong number.

Defined results: vectors that are null or hold null or non-finite components take no part. Every other row counts, also
rows that repeat a vec_id, each with its own rank and excluded only from its own list. A row without vec_id is a candidate
and no query; it comes behind the others of its score. Shorter vectors count as filled up with zeros. Ties go to the
smaller vec_id. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderflow.llm.common import discard, materialize

#: Slack of the bounds against rounding in floating point, relative to the numbers that they are made of.
SLACK = 1e-6
#: Below this, sums of products of integers are exact in float64.
EXACT = float(1 << 52)


def integer_vectors(df: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v array<bigint>: floor(scale * x) of each component, one row for each row of finite components."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = df.where(F.col("embedding").isNotNull()).where(~bad)
    too_large = F.raise_error(F.lit("a component is too large for a 64-bit integer")).cast("bigint")
    v = F.transform(x, lambda e: F.when(F.abs(e * scale) < 2.0**63, F.floor(e * scale).cast("bigint")).otherwise(too_large))
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    """The vectors of a batch, filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim), kind)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    for i, n in enumerate(lengths):
        out[i, :n] = flat[begins[i] : begins[i] + n]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: float64 where that is exact, else int64; an error beyond that."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    most = np.sqrt((x**2).sum(1).max(initial=0)) * np.sqrt((y**2).sum(1).max(initial=0))
    if most < EXACT:
        return x @ y.T
    if (np.abs(x) @ np.abs(y).T).max(initial=0) > 2.0**63 * (1 - 1e-9):
        raise OverflowError("an inner product is too large for a 64-bit integer")
    return a @ b.T


def _assign(pivots: np.ndarray):
    """Adds cell, the distance to its pivot, and the norm."""
    square = (pivots**2).sum(1)

    def run(batches):
        for b in batches:
            x = _matrix(b.column("v"), pivots.shape[1])
            own = (x**2).sum(1)
            d2 = own[:, None] - 2 * x @ pivots.T + square[None, :]
            cell = d2.argmin(1)
            dist = np.sqrt(np.maximum(((x - pivots[cell]) ** 2).sum(1), 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(dist), pa.array(np.sqrt(own))], names=[*b.schema.names, "cell", "dist", "norm"])

    return run


def plan_groups(pivots: np.ndarray, data: pd.DataFrame, queries: pd.DataFrame, k: int, group_queries: int):
    """(group of each query cell, need): need[g, s] is the least distance from pivot s at which a row may matter to g.

    data: cell, near (the k + 1 smallest distances); queries: cell, n, radius, norm. Neighbouring cells share a group as
    long as it has at most group_queries queries; a cell of more has a group of its own.
    """
    p = len(pivots)
    dots, length = pivots @ pivots.T, np.sqrt((pivots**2).sum(1))
    s = np.concatenate([np.full(len(near), cell) for cell, near in zip(data["cell"], data["near"], strict=True)]).astype(int)
    d = np.concatenate([np.asarray(near, float) for near in data["near"]])
    groups: dict[int, int] = {}
    needs: list[np.ndarray] = []
    info = {int(r.cell): r for r in queries.itertuples()}
    room = 0
    for c in _chain(pivots, queries["cell"].to_numpy(int)):
        r = info[c]
        low = dots[c, s] - r.radius * length[s] - r.norm * d
        least = -np.partition(-low, k)[k] if len(low) > k else -np.inf  # k + 1 rows, as one of them may be the query itself
        slack = SLACK * (1 + np.abs(dots[c]) + r.radius * length + (abs(least) if np.isfinite(least) else 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            need = (least - dots[c] - r.radius * length - slack) / r.norm if r.norm else np.where(least > slack, np.inf, -np.inf) * np.ones(p)
        need = np.where(np.isnan(need), -np.inf, need)
        if needs and r.n <= room:
            needs[-1] = np.minimum(needs[-1], need)
            room -= int(r.n)
        else:
            needs.append(need)
            room = group_queries - int(r.n)
        groups[c] = len(needs) - 1
    return groups, np.array(needs)


def _chain(pivots: np.ndarray, cells: np.ndarray) -> list[int]:
    """Cells in an order in which neighbours are close, so that groups of cells are compact."""
    left, out = set(map(int, cells)), []
    at = min(left)
    while left:
        left.discard(at)
        out.append(at)
        if left:
            rest = np.array(sorted(left))
            at = int(rest[((pivots[rest] - pivots[at]) ** 2).sum(1).argmin()])
    return out


CELLED = "uid long, vec_id long, v array<long>, is_query boolean, cell int, dist double, norm double"
FOUND = "quid long, query_id long, uid long, vec_id long, score long"


def _solver(k: int, dim: int):
    """Each query's k best of one block of data."""

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(4)]
        if q.num_rows and x.num_rows:
            ids, uid = x.column("vec_id"), x.column("uid").to_numpy()
            order = np.lexsort((uid, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()))  # nulls last
            uid, data = uid[order], np.ascontiguousarray(_matrix(x.column("v").combine_chunks(), dim, np.int64)[order])
            asked, points = q.column("uid").to_numpy(), _matrix(q.column("v").combine_chunks(), dim, np.int64)
            for i in range(0, len(asked), 256):
                score = products(points[i : i + 256], data)
                for j, one in enumerate(score):
                    n = min(len(one), k + 1)
                    best = np.flatnonzero(one >= np.partition(one, len(one) - n)[len(one) - n])
                    best = best[uid[best] != asked[i + j]]
                    best = best[np.lexsort((best, -one[best]))][:k]
                    for column, part in zip(out, (np.full(len(best), i + j), order[best], one[best].astype(np.int64), uid[best]), strict=True):
                        column.append(part)
        at, to, score, uids = (np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64) for c in out)
        columns = [q.column("uid").take(pa.array(at)), q.column("vec_id").take(pa.array(at)), pa.array(uids), x.column("vec_id").take(pa.array(to)), pa.array(score)]
        return pa.table(columns, names=["quid", "query_id", "uid", "vec_id", "score"])

    return solve


def top_k(vectors: DataFrame, is_query, k: int = 20, n_pivots: int | None = None, group_queries: int = 4096, block_rows: int = 16384, most_pivots: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows, for the rows that is_query selects.

    vectors: vec_id, v array<bigint>. n_pivots, group_queries, block_rows and most_pivots set sizes, never results.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    numbered = vectors.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("is_query"))
    vectors = materialize(numbered, "knn-vectors")  # written, so that a row keeps its number
    n_rows, dim = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n_rows:
        return empty
    n_pivots = n_pivots or min(most_pivots, max(64, int(n_rows**0.5)))
    sample = vectors.orderBy(F.xxhash64("uid"), "uid").limit(n_pivots).toPandas()
    pivots = np.zeros((len(sample), max(dim, 1)))
    for i, v in enumerate(sample["v"]):
        pivots[i, : len(v)] = v
    pivots = np.unique(pivots, axis=0)
    celled = materialize(vectors.mapInArrow(_assign(pivots), CELLED), "knn-cells")

    near = Window.partitionBy("cell").orderBy("dist")
    ranked = celled.select("cell", "dist").withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)  # a limit before the shuffle
    data = ranked.groupBy("cell").agg(F.collect_list("dist").alias("near")).toPandas()
    queries = celled.where("is_query").groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius"), F.max("norm").alias("norm")).toPandas()
    if queries.empty:
        return empty
    groups, needs = plan_groups(pivots, data, queries, k, group_queries)

    def to_groups(batches):
        for b in batches:
            cell, dist, norm = (b.column(c).to_numpy() for c in ("cell", "dist", "norm"))
            row, group = np.nonzero((dist + SLACK * (1 + norm))[:, None] >= needs.T[cell])
            yield pa.RecordBatch.from_arrays([*b.select(["uid", "vec_id", "v"]).take(pa.array(row)).columns, pa.array(group.astype(np.int32))], names=["uid", "vec_id", "v", "grp"])

    sent = materialize(celled.select("uid", "vec_id", "v", "cell", "dist", "norm").mapInArrow(to_groups, "uid long, vec_id long, v array<long>, grp int"), "knn-sent")
    n_data = {r["grp"]: r["count"] for r in sent.groupBy("grp").count().collect()}  # at most one row for each pivot
    asked = queries.groupby(queries["cell"].map(groups))["n"].sum()
    plan = spark.createDataFrame([(int(g), -(-int(n) // group_queries), max(1, -(-n_data.get(g, 0) // block_rows))) for g, n in asked.items()], "grp int, q_blocks int, x_blocks int")
    of_cell = spark.createDataFrame([(int(c), int(g)) for c, g in groups.items()], "cell int, grp int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda salt, n: F.pmod(F.xxhash64("uid", F.lit(salt)), F.col(n).cast("bigint")).cast("int")
    left = celled.where("is_query").select("uid", "vec_id", "v", "cell").join(F.broadcast(of_cell), "cell").join(F.broadcast(plan), "grp")
    left = left.select("uid", "vec_id", "v", "grp", block(3, "q_blocks").alias("qb"), upto("x_blocks").alias("xb"))
    right = sent.join(F.broadcast(plan), "grp").select("uid", "vec_id", "v", "grp", upto("q_blocks").alias("qb"), block(7, "x_blocks").alias("xb"))

    keys = ("grp", "qb", "xb")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_solver(k, max(dim, 1)), FOUND)
    best = Window.partitionBy("quid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    discard(vectors)
    return out


#: DuckDB SQL for the registered query.
ORACLE = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, x.vec_id AS vec_id, x.rid AS xid, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
      FROM v q JOIN v x ON q.rid <> x.rid WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, xid) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
