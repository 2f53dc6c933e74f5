"""Similarity search by an inverted file: L02, F06.

Centroids are fitted on a bounded sample (chosen by hash); every row is then filed under its nearest centroid, with the
residual as one byte for each component. A query reads the cells of its nearest centroids, scores their rows by the codes,
and the best of those are ranked again by their own vectors. How many cells a query reads is measured on a bounded sample of
the queries against an exact search, so that the wanted share of exact neighbours lies in the cells that are read.

Codes may mislead in the order of near ties, never in the score that is returned: it is the exact inner product. The exact
search (``vectors.top_similar``) stays for who needs every neighbour.

Defined results: rows whose embedding is null or holds null or non-finite components are not filed and no queries; shorter
vectors count as filled up with zeros; ties of the rounded similarity go to the smaller id; a query is no candidate of itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderflow.operators.scratch import written
from ladderflow.operators.vectors import dot, top_similar


@dataclass
class Codebook:
    """Centroids, and the step of each component's residual code."""

    centers: np.ndarray
    step: np.ndarray

    def order(self, x: np.ndarray) -> np.ndarray:
        """The cells of each row, nearest first."""
        return np.argsort((self.centers**2).sum(1)[None, :] - 2 * x @ self.centers.T, axis=1, kind="stable")

    def assign(self, x: np.ndarray) -> np.ndarray:
        return ((self.centers**2).sum(1)[None, :] - 2 * x @ self.centers.T).argmin(1)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((x - self.centers[cell]) / self.step), -127, 127).astype(np.int8)


def rows_of(df: DataFrame) -> DataFrame:
    """vec_id, v array<double> of the rows that can be compared."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return df.where("embedding IS NOT NULL AND vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).where(~bad)


def _stack(column, dim: int) -> np.ndarray:
    """Vectors of a column as rows, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim)[None, :] < lengths[:, None]] = flat
    return out


def fit(data: DataFrame, dim: int, n_rows: int, cells: int | None = None, sample_rows: int = 20_000, rounds: int = 8, seed: int = 3) -> Codebook:
    """Centroids by k-means over at most sample_rows rows; about the root of all rows, at most 1,024."""
    sample = _stack(data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow().column("v"), dim)
    cells = min(cells or max(8, min(1_024, int(n_rows**0.5))), len(sample))
    centers = sample[np.random.default_rng(seed).choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        own = ((centers**2).sum(1)[None, :] - 2 * sample @ centers.T).argmin(1)
        sums, n = np.zeros_like(centers), np.bincount(own, minlength=cells)
        np.add.at(sums, own, sample)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    book = Codebook(centers, np.ones(dim))
    book.step = np.maximum(np.abs(sample - centers[book.assign(sample)]).max(0), 1e-9) / 127
    return book


def build(data: DataFrame, book: Codebook) -> DataFrame:
    """vec_id, cell, code of every row: what a search reads, an eighth of the vectors' bytes."""
    dim = len(book.step)

    def run(batches):
        for b in batches:
            x = _stack(b.column("v"), dim)
            cell = book.assign(x)
            codes = [c.tobytes() for c in book.encode(x, cell)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cell.astype(np.int32)), pa.array(codes, pa.binary())], names=["vec_id", "cell", "code"])

    return data.mapInArrow(run, "vec_id long, cell int, code binary")


def calibrate(queries: DataFrame, index: DataFrame, data: DataFrame, book: Codebook, k: int, recall: float, sample: int = 256) -> tuple[int, float]:
    """(cells to read, the recall they reach) on at most so many queries, whose exact neighbours are searched by blocks."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    filled = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(len(book.step)) - F.size("v"))).alias("embedding")
    exact = top_similar(some.select("vec_id", filled), data.select("vec_id", filled), k)
    placed = exact.join(index.select(F.col("vec_id").alias("x"), "cell"), "x").select("q", "cell")
    truth: dict[int, list[int]] = {}
    for r in placed.collect():  # sample * k rows
        truth.setdefault(r["q"], []).append(r["cell"])
    places = []
    for r in some.where(F.col("vec_id").isin(list(truth))).collect():
        v = np.zeros((1, len(book.step)))
        v[0, : len(r["v"])] = r["v"]
        rank = np.argsort(book.order(v)[0])
        places += [rank[c] for c in truth[r["vec_id"]]]
    places = np.sort(np.array(places or [0]))
    probes = int(places[max(0, int(np.ceil(recall * len(places))) - 1)]) + 1
    return probes, float((places < probes).mean())


def _scorer(book: Codebook, keep: int):
    """The best rows of a block of one cell for each query that reads it, scored by their codes."""
    dim = len(book.step)

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if q.num_rows and x.num_rows:
            ids, cell = x.column("vec_id").to_numpy(), int(x.column("cell")[0].as_py())
            codes = np.frombuffer(b"".join(x.column("code").to_pylist()), np.int8).reshape(-1, dim)
            near = book.centers[cell] + codes * book.step
            asked = q.column("vec_id").to_numpy()
            points = _stack(q.column("v"), dim)
            for i in range(0, len(asked), 512):
                score = points[i : i + 512] @ near.T
                n = min(keep + 1, len(ids))  # one of them may be the query itself
                best = np.argpartition(-score, n - 1, axis=1)[:, :n]
                row = np.repeat(np.arange(len(score)), n)
                for column, part in zip(out, (asked[i + row], ids[best.ravel()], score[row, best.ravel()]), strict=True):
                    column.append(part)
        q_id, x_id, s = (np.concatenate(c) if c else np.empty(0) for c in out)
        other = q_id != x_id
        return pa.table({"q": pa.array(q_id[other].astype(np.int64)), "x": pa.array(x_id[other].astype(np.int64)), "near": pa.array(s[other].astype(np.float64))})

    return solve


def search(queries: DataFrame, index: DataFrame, data: DataFrame, book: Codebook, k: int, probes: int, refine: int = 8, block_rows: int = 16_384, query_rows: int = 4_096) -> DataFrame:
    """q, x, sim, rank: the k most similar other rows found in so many cells for each query (vec_id, v). The k * refine best by
    code are ranked by their own vectors. Blocks of rows and queries bound a task."""
    dim = len(book.step)

    def cells_of(batches):
        for b in batches:
            order = book.order(_stack(b.column("v"), dim))[:, :probes]
            row = np.repeat(np.arange(len(order)), order.shape[1])
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(row, pa.int64())).columns, pa.array(order.ravel().astype(np.int32))], names=["vec_id", "v", "cell"])

    asked = queries.select("vec_id", "v").mapInArrow(cells_of, "vec_id long, v array<double>, cell int")
    spark = data.sparkSession
    n_x = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}  # one row for each cell
    n_q = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
    plan = F.broadcast(spark.createDataFrame([(c, -(-n // query_rows), -(-n_x[c] // block_rows)) for c, n in n_q.items() if c in n_x], "cell int, q_blocks int, x_blocks int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n).cast("long")).cast("int")
    left = asked.join(plan, "cell").select("vec_id", "v", "cell", block("q_blocks").alias("qb"), upto("x_blocks").alias("xb"))
    right = index.join(plan, "cell").select("vec_id", "code", "cell", upto("q_blocks").alias("qb"), block("x_blocks").alias("xb"))
    keys = ("cell", "qb", "xb")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scorer(book, k * refine), "q long, x long, near double")
    by_code = Window.partitionBy("q").orderBy(F.desc("near"), "x")
    few = near.withColumn("r", F.row_number().over(by_code)).where(F.col("r") <= k * refine).select("q", "x")
    pairs = few.join(data.select(F.col("vec_id").alias("x"), F.col("v").alias("b")), "x").join(queries.select(F.col("vec_id").alias("q"), F.col("v").alias("a")), "q")
    n = F.least(F.size("a"), F.size("b"))
    exact = dot(F.slice("a", F.lit(1), n), F.slice("b", F.lit(1), n))
    sim = (F.floor(exact * 1e4 + 0.5) / 1e4).alias("sim")
    by_sim = Window.partitionBy("q").orderBy(F.desc("sim"), "x")
    return pairs.select("q", "x", sim).withColumn("rank", F.row_number().over(by_sim)).where(F.col("rank") <= k)


def indexed_top(queries: DataFrame, data: DataFrame, k: int, recall: float = 0.95, refine: int = 8) -> DataFrame:
    """L02 by the index: fits, files every row, measures how many cells to read, and searches. queries and data have vec_id and
    embedding; ids are keys."""
    x, asked = written(rows_of(data), "index-rows"), written(rows_of(queries), "index-queries")
    n_rows, dim = x.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n_rows or asked.isEmpty():
        return data.sparkSession.createDataFrame([], "q long, x long, sim double, rank int")
    book = fit(x, dim, n_rows)
    index = written(build(x, book), "index-codes")
    probes, _ = calibrate(asked, index, x, book, k, recall)
    return search(asked, index, x, book, k, probes, refine)


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact neighbours (q, x, sim) that a search found, or that it found one as good in place of."""
    least = exact.groupBy("q").agg(F.min("sim").alias("least"), F.count("*").alias("n"))
    good = found.join(least, "q", "right").groupBy("q").agg(F.least(F.count(F.when(F.col("sim") >= F.col("least"), 1)), F.first("n")).alias("good"), F.first("n").alias("n"))
    row = good.agg(F.sum("good"), F.sum("n")).first()
    return row[0] / row[1] if row[1] else 1.0
