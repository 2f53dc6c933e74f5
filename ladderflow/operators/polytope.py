"""Prices and logical constraints: feasibility, vertices, projections.

Constraint systems are small and many: what one system needs stays within one group. Tests of feasibility are plain
aggregates; iterative projections run over all groups of one size of an Arrow batch at once. Vertices of a general system are
enumerated, which bounds it to MAX_VARIABLES variables (an error above); systems that add up to 1 have no such bound.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most variables for which all 0/1 vertices are enumerated.
MAX_VARIABLES = 16


def feasible(terms: DataFrame, constraints: DataFrame, points: DataFrame, tolerance: float = 1e-5, tasks: int | None = None) -> DataFrame:
    """Whether the point (group_id, idx, value) meets all constraints of its group. With tasks, the sums are dealt to so many, and
    terms and points should come dealt to as many by group_id and idx, constraints by group_id and c_id."""
    met = terms.join(points, ["group_id", "idx"]).select("group_id", "c_id", (F.col("coeff") * F.col("value")).alias("v"))
    sums = (met.repartition(tasks, "group_id", "c_id") if tasks else met).groupBy("group_id", "c_id").agg(F.sum("v").alias("v"))
    x, rhs = F.col("v"), F.col("rhs")
    met = F.when(F.col("sense") == ">=", x >= rhs - tolerance).when(F.col("sense") == "<=", x <= rhs + tolerance).otherwise(F.abs(x - rhs) <= tolerance)
    return constraints.join(sums, ["group_id", "c_id"]).groupBy("group_id").agg(F.bool_and(met).alias("feasible"))


class System:
    """A constraint system over n variables: rows (coefficients by index, sense, right side)."""

    def __init__(self, n: int, rows: list[tuple[dict[int, float], str, float]]):
        self.n, self.rows = n, rows
        self.a = np.array([[c.get(i, 0.0) for i in range(n)] for c, _, _ in rows]).reshape(len(rows), n)
        self.b = np.array([r for _, _, r in rows])
        self.sense = [s for _, s, _ in rows]
        self._vertices = None

    def holds(self, x: np.ndarray, tolerance: float = 1e-5) -> np.ndarray:
        """Whether points (rows of x) meet all constraints."""
        v = np.atleast_2d(x) @ self.a.T
        ok = np.ones(len(v), bool)
        for j, s in enumerate(self.sense):
            d = v[:, j] - self.b[j]
            ok &= d >= -tolerance if s == ">=" else d <= tolerance if s == "<=" else np.abs(d) <= tolerance
        return ok

    def vertices(self) -> np.ndarray:
        """All feasible 0/1 points, enumerated once for each system."""
        if self._vertices is None:
            if len(self.rows) == 1 and self.sense == ["="] and self.b[0] == 1 and (self.a == 1).all():
                self._vertices = np.eye(self.n)[::-1]
                return self._vertices
            if self.n > MAX_VARIABLES:
                raise ValueError(f"vertices are enumerated for at most {MAX_VARIABLES} variables")
            every = np.array(list(itertools.product((0.0, 1.0), repeat=self.n)))
            self._vertices = every[self.holds(every, 1e-9)]
        return self._vertices

    def descent_vertex(self, gradient: np.ndarray) -> np.ndarray:
        """The feasible vertex of least inner product with the gradient; the first on ties."""
        v = self.vertices()
        if not len(v):
            raise ValueError("no feasible vertex")
        return v[(v @ gradient).argmin()].copy()

    def status(self) -> str:
        """Whether the system has a 0/1 point."""
        return "Optimal" if len(self.vertices()) else "Infeasible"

    def project(self, x: np.ndarray, sweeps: int = 100, split_equalities: bool = False) -> np.ndarray:
        """Cyclic projection onto half-spaces and the unit box. Equalities are left out as in the original, or split
        into both inequalities."""
        x = x.astype(float).copy()
        for _ in range(sweeps):
            violated = False
            for a, s, b in zip(self.a, self.sense, self.b, strict=True):
                norm, gap = a @ a, b - a @ x
                up = gap > 0 and (s == ">=" or (s == "=" and split_equalities))
                down = gap < 0 and (s == "<=" or (s == "=" and split_equalities))
                if up or down:
                    violated = True
                    if norm > 0:
                        x = x + gap / norm * a
            x = np.clip(x, 0, 1)
            if not violated:
                break
        return x


def project_prices(prices: np.ndarray, sums: list[tuple[list[int], float]], implications: list[tuple[int, int, float]], sweeps: int = 100) -> np.ndarray:
    """Cyclic projection onto sums and implications (a at least b plus a difference), within .001 and .999."""
    x = prices.astype(float).copy()
    for _ in range(sweeps):
        before = x.copy()
        for indices, target in sums:
            total = x[indices].sum()
            if abs(total - target) > 1e-6:
                x[indices] += (target - total) / len(indices)
        for a, b, least in implications:
            if x[a] < x[b] + least:
                x[a] = (x[a] + x[b] + least) / 2
                x[b] = x[a] - least
        x = np.clip(x, 0.001, 0.999)
        if np.abs(x - before).max(initial=0) < 1e-6:
            break
    return x


def frank_wolfe(theta: np.ndarray, system: System, rounds: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """Projection in KL divergence by steps 2 / (t + 2) towards descent vertices."""
    mu = system.descent_vertex(np.zeros(system.n))
    for t in range(rounds):
        g = np.log(np.clip(mu, 1e-9, 1)) - np.log(np.clip(theta, 1e-9, 1))
        s = system.descent_vertex(g)
        if g @ (mu - s) <= tolerance:
            break
        mu += 2 / (t + 2) * (s - mu)
    return mu


def barrier_frank_wolfe(theta: np.ndarray, system: System, rounds: int = 200, tolerance: float = 1e-6, epsilon: float = 0.1, volatile: bool = False) -> np.ndarray:
    """The same with a log barrier over the polytope drawn in towards its centre; epsilon is the share of the centre.

    It decays faster in volatile markets, which also get fewer rounds; more than five rounds of one gap end the search.
    """
    centre = np.full(system.n, 1 / system.n)
    drawn = lambda z, e: (1 - e) * z + e * centre
    mu = drawn(system.descent_vertex(np.zeros(system.n)), epsilon)
    if volatile:
        rounds, epsilon = min(rounds, 50), epsilon * 0.5
    last, stalls = np.inf, 0
    for t in range(rounds):
        m = np.clip(mu, 1e-12, 1 - 1e-12)
        g = np.log(m) - np.log(np.clip(theta, 1e-12, 1)) + 0.01 * (1 / (1 - m) - 1 / m)
        target = drawn(system.descent_vertex(g), epsilon)
        gap = g @ (mu - target)
        if gap <= tolerance:
            break
        stalls = stalls + 1 if abs(last - gap) < tolerance * 0.1 else 0
        if stalls > 5:
            break
        last = gap
        if volatile:
            epsilon = max(1e-8, epsilon * 0.8)
        elif gap < 10 * epsilon:
            epsilon = max(1e-6, epsilon * 0.9)
        mu = np.clip(mu + 2 / (t + 2) * (target - mu), 1e-12, 1 - 1e-12)
    return mu


def cyclic_batch(x: np.ndarray, low: float, high: float, least_gap: float, least_move: float, sweeps: int = 100) -> np.ndarray:
    """G09, G10 for rows of prices that must add up to 1: shift all to the sum, clip to the box, until nothing moves."""
    x = x.astype(float).copy()
    active = np.ones(len(x), bool)
    for _ in range(sweeps):
        if not active.any():
            break
        gap = 1 - x[active].sum(1)
        moved = np.clip(x[active] + np.where(np.abs(gap) > least_gap, gap / x.shape[1], 0.0)[:, None], low, high)
        still = (np.abs(moved - x[active]).max(1) >= least_move) if least_move else np.abs(gap) > least_gap
        x[active] = moved
        active[np.flatnonzero(active)[~still]] = False
    return x


def frank_wolfe_batch(theta: np.ndarray, barrier: bool, rounds: int | None = None, tolerance: float = 1e-6, epsilon: float = 0.1) -> np.ndarray:
    """G12, G13 (calm markets) for rows of prices that must add up to 1, whose vertices are the unit vectors."""
    g, n = theta.shape
    eps, unit, clip = np.full(g, epsilon if barrier else 0.0), np.eye(n), 1e-12 if barrier else 1e-9
    drawn = lambda z, e: (1 - e[:, None]) * z + e[:, None] / n
    mu = drawn(np.repeat(unit[-1:], g, 0), eps)
    last, stalls, active = np.full(g, np.inf), np.zeros(g, int), np.ones(g, bool)
    for t in range(rounds or (200 if barrier else 100)):
        at = np.flatnonzero(active)
        if not len(at):
            break
        m = np.clip(mu[at], clip, 1 - clip if barrier else 1)
        grad = np.log(m) - np.log(np.clip(theta[at], clip, 1))
        if barrier:
            grad = grad + 0.01 * (1 / (1 - m) - 1 / m)
        target = drawn(unit[n - 1 - grad[:, ::-1].argmin(1)], eps[at])
        gap = (grad * (mu[at] - target)).sum(1)
        done = gap <= tolerance
        if barrier:
            stalls[at] = np.where(np.abs(last[at] - gap) < tolerance * 0.1, stalls[at] + 1, 0)
            done |= stalls[at] > 5
            last[at] = gap
            eps[at] = np.where(~done & (gap < 10 * eps[at]), np.maximum(1e-6, eps[at] * 0.9), eps[at])
        step = mu[at] + 2 / (t + 2) * (target - mu[at])
        mu[at[~done]] = (np.clip(step, clip, 1 - clip) if barrier else step)[~done]
        active[at[done]] = False
    return mu


METHODS = {
    "cyclic": lambda x: cyclic_batch(x, 0.001, 0.999, 1e-6, 1e-6), "half-space": lambda x: cyclic_batch(x, 0.0, 1.0, 0.0, 0.0),
    "barrier": lambda x: frank_wolfe_batch(x, True), "frank-wolfe": lambda x: frank_wolfe_batch(x, False),
}


def project_groups(prices: DataFrame, method: str = "cyclic") -> DataFrame:
    """G09 to G13 over groups: prices (group_id, idx, price) of outcomes that must add up to 1; gives idx, price, fair. A group
    is an array, and the groups of one size in a batch are solved at once."""
    solve = METHODS[method]
    rows = prices.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("price").cast("double").alias("price")))).alias("x"))
    arrays = rows.select("group_id", F.transform("x", lambda r: r["idx"].cast("int")).alias("idx"), F.transform("x", lambda r: r["price"]).alias("price"))

    def run(batches):
        for b in batches:
            price = b.column("price").to_pylist()
            sizes, fair = np.array([len(x) for x in price], int), [None] * len(price)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                for i, x in zip(at, solve(np.array([price[i] for i in at])), strict=True):
                    fair[i] = x
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fair, pa.list_(pa.float64()))], names=["group_id", "idx", "price", "fair"])

    out = arrays.mapInArrow(run, "group_id long, idx array<int>, price array<double>, fair array<double>")
    return out.select("group_id", F.explode(F.arrays_zip("idx", "price", "fair")).alias("z")).select("group_id", "z.*")


@lru_cache(500)
def _status(n: int, rows: tuple) -> str:
    return System(n, [(dict(enumerate(c)), s, r) for c, s, r in rows]).status()


def statuses(systems: DataFrame) -> DataFrame:
    """Whether each system (group_id, n, rows array<struct<coeffs, sense, rhs>>) has a 0/1 point. Equal systems are
    solved once, and a worker remembers the last 500."""

    def run(batches):
        for b in batches:
            rows = [tuple((tuple(r["coeffs"]), r["sense"], r["rhs"]) for r in x) for x in b.column("rows").to_pylist()]
            out = [_status(n, r) for n, r in zip(b.column("n").to_pylist(), rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=["n", "rows", "status"])

    one = systems.select("n", "rows").distinct()
    kind = systems.schema["rows"].dataType.simpleString()
    return systems.join(one.mapInArrow(run, f"n int, rows {kind}, status string"), ["n", "rows"]).select("group_id", "status")


def best_deviation(projected: DataFrame, least: float = 0.01) -> DataFrame:
    """The outcome of each group whose price is farthest from its fair price, if that is far enough."""
    gap = F.col("fair") - F.col("price")
    best = projected.groupBy("group_id").agg(F.max_by(F.struct("idx", "price", "fair"), F.struct(F.abs(gap), -F.col("idx"))).alias("b"))
    edge = F.col("b.fair") - F.col("b.price")
    return best.where(F.abs(edge) >= least).select("group_id", F.col("b.idx").alias("idx"), F.when(edge > 0, "buy").otherwise("sell").alias("side"), F.abs(edge).alias("edge"))


def online_ensemble(rows: DataFrame, features: list[str], label: str, key: str = "key", rate: float = 0.05, decay: float = 0.99) -> DataFrame:
    """Weights of each key's logistic model after one ordered pass with decay; order matters, so a key is one task."""

    def run(k, part: pd.DataFrame) -> pd.DataFrame:
        w = np.zeros(len(features) + 1)
        for r in part.sort_values(["ts", "seq"])[[*features, label]].to_numpy(float):
            x = np.append(r[:-1], 1.0)
            w = w * decay + rate * (r[-1] - 1 / (1 + np.exp(-np.clip(w @ x, -40, 40)))) * x
        return pd.DataFrame([[k[0], w.tolist()]], columns=[key, "weights"])

    return rows.groupBy(key).applyInPandas(run, f"{key} long, weights array<double>")
