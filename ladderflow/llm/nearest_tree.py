"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

A tree of k-means splits is fitted on a bounded sample (``sample_rows`` rows and ``sample_bytes`` bytes at most, chosen by
hash); every row then goes down to its leaf. A query keeps a priority queue of the branches that it has not taken: the
nearest one is opened next, so leaves are visited in the order of promise. How many leaves a query visits is calibrated: for
a bounded sample of the queries the exact neighbours are found by brute force over all rows, visits are widened, doubling and
then by halving the last step, until the share of those neighbours in visited leaves reaches ``recall``.

Neighbouring leaves are packed into shards, and a shard is solved in (query block, data block) pairs of bounded size, one task
each: a query goes once to each shard that holds leaves it visits. The driver holds the tree, the number of rows of each leaf
and the calibration queries: all bounded.

Equal vectors are one point: it keeps the k + 1 rows that come first by vec_id, which are all that any list can need, and a
query vector is searched once. So a vector that a third of all rows share costs no more than another.

Defined results: vectors that are null, zero or hold null or non-finite components take no part. Every other row counts, also
rows that repeat a vec_id, each with its own list and excluded only from that. A row without vec_id is a candidate and no
query; it comes behind the others of its score. Shorter vectors count as filled up with zeros. Ties go to the smaller
vec_id. A query visits further leaves while they hold fewer than k candidates, so a list is short only if there are no
more rows. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderflow.llm.common import attach, discard, materialize
from ladderflow.llm.vectors import finite_vectors, matrix


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; huge and tiny rows are brought to an ordinary size by a power of two first, which is exact."""
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows whose largest component is about 1, so that no square overflows or vanishes; the cosine stays what it was."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with the row of b beside it, the same whatever other rows are there."""
    a, b = scaled(a), scaled(b)
    return np.clip((a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))), -1.0, 1.0)


class Tree:
    """Centres of the nodes, children of each, and leaves numbered from left to right."""

    def __init__(self, sample: np.ndarray, leaf_share: float, branches: int = 8, rounds: int = 6, seed: int = 7):
        """sample: unit rows; nodes of more than leaf_share of the sample are split."""
        self.centers: list[np.ndarray] = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])]
        self.children: list[list[int]] = [[]]
        rng = np.random.default_rng(seed)
        open_nodes = [(0, sample)]
        while open_nodes:
            node, rows = open_nodes.pop()
            if len(rows) <= max(leaf_share * len(sample), 2 * branches):
                continue
            own, centers = _split(rows, branches, rounds, rng)
            if len(centers) < 2:
                continue  # copies of one point
            for c, center in enumerate(centers):
                self.children[node].append(len(self.centers))
                open_nodes.append((len(self.centers), rows[own == c]))
                self.centers.append(center)
                self.children.append([])
        self.points = np.array(self.centers)
        self.square = (self.points**2).sum(1)
        self.leaf: dict[int, int] = {}
        stack = [0]
        while stack:  # from left to right: neighbours get neighbouring numbers
            node = stack.pop()
            if self.children[node]:
                stack += reversed(self.children[node])
            else:
                self.leaf[node] = len(self.leaf)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of unit rows to all nodes."""
        return 1 + self.square[None, :] - 2 * x @ self.points.T

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down to the nearest child."""
        d, at = self.distances(x), np.zeros(len(x), np.int64)
        moving = np.arange(len(x))
        while len(moving):
            for node in np.unique(at[moving]):
                kids = self.children[node]
                rows = moving[at[moving] == node]
                if kids:
                    at[rows] = np.array(kids)[d[np.ix_(rows, kids)].argmin(1)]
            moving = moving[[bool(self.children[n]) for n in at[moving]]]
        return np.array([self.leaf[n] for n in at], np.int32)

    def visits(self, d: np.ndarray):
        """The leaves in the order of best bin first, by one query's distances to all nodes."""
        queue: list[tuple[float, int]] = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while kids := self.children[node]:
                ordered = sorted(kids, key=lambda n: d[n])
                for n in ordered[1:]:
                    heapq.heappush(queue, (d[n], n))
                node = ordered[0]
            yield self.leaf[node]


def _split(rows: np.ndarray, k: int, rounds: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """k-means of a node: the cluster of each row, and the centres of the clusters that have rows."""
    centers = rows[[rng.integers(len(rows))]]
    gap = ((rows - centers[0]) ** 2).sum(1)
    while len(centers) < k and gap.max() > 1e-18:  # k-means++: far rows are likelier
        new = rows[rng.choice(len(rows), p=gap / gap.sum())]
        centers = np.vstack([centers, new])
        gap = np.minimum(gap, ((rows - new) ** 2).sum(1))
    own = np.zeros(len(rows), np.int64)
    for _ in range(rounds):
        own = ((centers**2).sum(1)[None, :] - 2 * rows @ centers.T).argmin(1)
        kept = np.unique(own)
        centers = np.array([rows[own == c].mean(0) for c in kept])
        own = np.searchsorted(kept, own)
    own = ((centers**2).sum(1)[None, :] - 2 * rows @ centers.T).argmin(1)
    kept = np.unique(own)
    return np.searchsorted(kept, own), centers[kept]


def _best(scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's n highest scores, and of all within rounding of the last of them."""
    n = min(n, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
    return np.nonzero(scores >= (least - 1e-12)[:, None])


def _solver(dim: int, k: int):
    """One pair of blocks: the k + 1 best points of each query among the leaves that it visits."""

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if q.num_rows and x.num_rows:
            head = x.column("head")
            order = np.lexsort((x.column("gid").to_numpy(), head.fill_null(0).to_numpy(), head.is_null().to_numpy()))  # nulls last
            x = x.take(pa.array(order))
            leaf, leaves = x.column("leaf").to_numpy(), q.column("leaves").to_pylist()
            data, points = matrix(x.column("v").combine_chunks(), dim), matrix(q.column("v").combine_chunks(), dim)
            near, wanted = unit(data), unit(points)
            visitors: dict[int, list[int]] = {}
            for i, own in enumerate(leaves):
                for n in own:
                    visitors.setdefault(n, []).append(i)
            for n in np.unique(leaf):
                rows, who = np.flatnonzero(leaf == n), np.array(visitors.get(int(n), []), np.int64)
                for i in range(0, len(who), 1024):
                    some = who[i : i + 1024]
                    a, b = _best(wanted[some] @ near[rows].T, k + 1)
                    for column, part in zip(out, (some[a], rows[b], cosines(points[some[a]], data[rows[b]])), strict=True):
                        column.append(part)
        a, b, s = (np.concatenate(c) if c else np.empty(0) for c in out)
        order = np.lexsort((b, -s, a))  # rows of data stand in the order of ties
        a, b, s = a[order].astype(np.int64), b[order].astype(np.int64), s[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        a, b, s = a[place <= k], b[place <= k], s[place <= k]
        columns = [q.column("gid").take(pa.array(a)), x.column("gid").take(pa.array(b)), x.column("head").take(pa.array(b)), pa.array(s.astype(np.float64))]
        return pa.table(columns, names=["qid", "gid", "head", "score"])

    return solve


def points_of(df: DataFrame, is_query: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """(points, asked): gid, head, v, members (the k + 1 first rows) of each distinct vector; uid, query_id, gid of each query row."""
    rows = finite_vectors(df, F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("bigint").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.where(F.exists("x", lambda e: e != 0)).select("uid", "vec_id", "is_query", F.transform("x", lambda e: e + F.lit(0.0)).alias("v"))
    rows = materialize(rows, "ann-rows")  # written, so that a row keeps its number
    first = Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"), "uid")
    few = rows.select("uid", "vec_id", "v").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)  # a limit before the shuffle
    members = F.sort_array(F.collect_list(F.struct("r", "vec_id", "uid"))).alias("members")
    head = F.col("members")[0]
    points = materialize(few.groupBy("v").agg(members).select(head["uid"].alias("gid"), head["vec_id"].alias("head"), "v", "members"), "ann-points")
    asked = materialize(rows.where("is_query").select("uid", F.col("vec_id").alias("query_id"), "v"), "ann-asked")
    named = materialize(attach(asked, points, {"v": "v"}, {"gid": "gid"}).select("uid", "query_id", "gid"), "ann-queries")
    discard(rows, asked)
    return points, named


def exact_leaves(celled: DataFrame, probes: np.ndarray, dim: int, k: int) -> np.ndarray:
    """(probe, leaf) of the k exact nearest other points of each probe, by one pass over all rows; probes are few."""

    def score(batches):
        for b in batches:
            x, ids, leaf = unit(matrix(b.column("v"), dim)), b.column("gid").to_numpy(), b.column("leaf").to_numpy()
            if len(x):
                p, r = _best(probes @ x.T, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(ids[r]), pa.array(leaf[r]), pa.array((probes[p] * x[r]).sum(1))], names=["p", "gid", "leaf", "score"])

    best = Window.partitionBy("p").orderBy(F.desc("score"), "gid")
    found = celled.select("gid", "v", "leaf").mapInArrow(score, "p int, gid long, leaf int, score double")
    top = found.withColumn("r", F.row_number().over(best)).where((F.col("r") > 1) & (F.col("r") <= k + 1))  # the first is the probe itself
    return np.array([(r["p"], r["leaf"]) for r in top.select("p", "leaf").collect()], np.int64).reshape(-1, 2)


def calibrate(tree: Tree, probes: np.ndarray, truth: np.ndarray, recall: float) -> tuple[int, float]:
    """The number of leaves to visit and the recall that it reaches on the probes: widened by doubling until the recall is
    reached, then narrowed by halving the last step."""
    place = np.zeros((len(probes), len(tree.leaf)), np.int64)
    for i, d in enumerate(tree.distances(probes)):
        for n, leaf in enumerate(tree.visits(d)):
            place[i, leaf] = n
    ranks = place[truth[:, 0], truth[:, 1]] if len(truth) else np.zeros(1)
    reached = lambda n: float((ranks < n).mean())
    high = 1
    while reached(high) < recall and high < len(tree.leaf):
        high *= 2
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if reached(mid) >= recall else (mid, high)
    high = min(high, len(tree.leaf))
    return high, reached(high)


def shards(counts: dict[int, int], n_leaves: int, block_rows: int) -> tuple[dict[int, int], dict[int, int]]:
    """(shard of each leaf that has rows, rows of each shard): neighbouring leaves share a shard of at most block_rows rows; a
    larger leaf is a shard of its own."""
    of_leaf: dict[int, int] = {}
    rows: dict[int, int] = {}
    shard = 0
    for leaf in range(n_leaves):
        if n := counts.get(leaf, 0):
            if rows.get(shard, 0) and rows[shard] + n > block_rows:
                shard += 1
            of_leaf[leaf] = shard
            rows[shard] = rows.get(shard, 0) + n
    return of_leaf, rows


def nearest(
    df: DataFrame, is_query: Column, k: int = 5, recall: float = 0.97, leaf_rows: int = 128, sample_rows: int = 20_000, sample_bytes: int = 64 << 20, probe_rows: int = 256, query_rows: int = 4_096, block_rows: int = 16_384
) -> DataFrame:
    """query_id, rank, vec_id, score, leaves (the calibrated number of visits): the k nearest found of all other rows, for the
    rows that is_query selects. leaf_rows, sample_rows and sample_bytes shape the tree, probe_rows is the size of the
    calibration; query_rows and block_rows set the sizes of tasks, never results."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, leaves int")
    points, queries = points_of(df, is_query, k)
    n_points, dim = points.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n_points or queries.isEmpty():
        return empty
    by_hash = lambda t, n: t.orderBy(F.xxhash64("v"), "v").limit(n).select("v")
    stack = lambda t: unit(matrix(t.toArrow().column("v").combine_chunks(), dim))
    most = max(1, sample_bytes // (8 * dim))
    tree = Tree(stack(by_hash(points, min(sample_rows, most))), leaf_rows / n_points)

    def to_leaf(batches):
        for b in batches:
            leaf = tree.assign(unit(matrix(b.column("v"), dim)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=[*b.schema.names, "leaf"])

    celled = materialize(points.select("gid", "head", "v").mapInArrow(to_leaf, "gid long, head long, v array<double>, leaf int"), "ann-leaves")
    counts = {r["leaf"]: r["count"] for r in celled.groupBy("leaf").count().collect()}  # one row for each leaf
    wanted = materialize(celled.join(queries.select("gid").distinct(), "gid", "left_semi").select("gid", "v"), "ann-wanted")
    probes = stack(by_hash(wanted, min(probe_rows, most)))
    least, _ = calibrate(tree, probes, exact_leaves(celled, probes, dim, k), recall)
    of_leaf, shard_rows = shards(counts, len(tree.leaf), block_rows)

    def visit(batches):
        for b in batches:
            row, shard, leaves = [], [], []
            for i, d in enumerate(tree.distances(unit(matrix(b.column("v"), dim)))):
                seen, here = 0, {}
                for n, leaf in enumerate(tree.visits(d)):
                    if n >= least and seen > k:  # one of those seen may be the query itself
                        break
                    seen += counts.get(leaf, 0)
                    if leaf in of_leaf:
                        here.setdefault(of_leaf[leaf], []).append(leaf)
                row += [i] * len(here)
                shard += here
                leaves += here.values()
            taken = b.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(shard, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], names=["gid", "v", "shard", "leaves"])

    visits = materialize(wanted.mapInArrow(visit, "gid long, v array<double>, shard int, leaves array<int>"), "ann-visits")
    asked = {r["shard"]: r["count"] for r in visits.groupBy("shard").count().collect()}  # at most one row for each leaf
    blocks = lambda n, size: max(1, -(-n // size))
    plan = F.broadcast(spark.createDataFrame([(s, blocks(n, query_rows), blocks(shard_rows[s], block_rows)) for s, n in asked.items()], "shard int, q_blocks int, x_blocks int"))
    place = F.broadcast(spark.createDataFrame(list(of_leaf.items()), "leaf int, shard int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda salt, n: F.pmod(F.xxhash64("gid", F.lit(salt)), F.col(n).cast("bigint")).cast("int")
    left = visits.join(plan, "shard").select("gid", "v", "leaves", "shard", block(3, "q_blocks").alias("qb"), upto("x_blocks").alias("xb"))
    right = celled.join(place, "leaf").join(plan, "shard").select("gid", "head", "v", "leaf", "shard", upto("q_blocks").alias("qb"), block(7, "x_blocks").alias("xb"))
    keys = ("shard", "qb", "xb")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_solver(dim, k), "qid long, gid long, head long, score double")

    # k + 1 points are enough: each stands for one row at least, and one of those may be the query itself
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("head"), "gid")
    top = materialize(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("qid", "gid", "score"), "ann-found")
    lists = attach(top, points, {"gid": "gid"}, {"members": "members"}).groupBy("qid").agg(F.collect_list(F.struct("score", "members")).alias("found"))
    each = attach(queries, materialize(lists, "ann-lists"), {"gid": "qid"}, {"found": "found"}).select("uid", "query_id", F.explode("found").alias("f"))
    rows = each.select("uid", "query_id", F.col("f.score").alias("score"), F.explode("f.members").alias("m")).where(F.col("m.uid") != F.col("uid"))
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("m.vec_id"), "m.uid")
    out = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("m.vec_id").alias("vec_id"), "score", F.lit(least).alias("leaves"))
    discard(celled, wanted, visits)
    return out
