"""General systems of linear constraints over 0/1 outcomes: G05, G06, G08, G12, G13.

Systems are many and each is small: its constraints and variables are gathered in one row, and rows are solved where they lie.
A system of more variables than are enumerated (polytope.MAX_VARIABLES) is split into the parts that no constraint joins, and each
part is searched by branch and bound: constraints fix what must be (propagation), and disjoint groups of outcomes bound what
the rest can still gain. A search beyond ``most_nodes`` nodes is an error, never a wrong point.

Whether prices can meet all constraints at all (G05) is asked of the box [0, 1], not of its corners: a simplex of phase one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderflow.operators.polytope import MAX_VARIABLES, System, barrier_frank_wolfe, frank_wolfe

#: Slack of comparisons of sums.
SLACK = 1e-9
MOST_NODES = 200_000
Row = tuple[dict[int, float], str, float]


class Search:
    """Branch and bound over one joined part of a system: ``low`` holds rows a . z >= b, ``groups`` disjoint rows of ones."""

    def __init__(self, variables: list[int], rows: list[Row], gradient: np.ndarray, most_nodes: int):
        self.variables, self.g, self.left = variables, gradient, most_nodes
        self.low: list[tuple[list[tuple[int, float]], float]] = []
        for coeffs, sense, b in rows:
            if sense in (">=", "="):
                self.low.append((list(coeffs.items()), b))
            if sense in ("<=", "="):
                self.low.append(([(i, -c) for i, c in coeffs.items()], -b))
        self.of: dict[int, list[int]] = {v: [] for v in variables}
        for r, (terms, _) in enumerate(self.low):
            for i, _ in terms:
                self.of[i].append(r)
        self.groups, self.rest = [], set(variables)
        for coeffs, sense, b in sorted(rows, key=lambda r: (r[1] != "=", -len(r[0]))):
            if coeffs and set(coeffs) <= self.rest and all(c == 1 for c in coeffs.values()):
                self.groups.append((sorted(coeffs, key=lambda i: gradient[i]), sense, b))
                self.rest -= set(coeffs)

    def fix(self, z: dict[int, int], first: list[tuple[int, int]]) -> bool:
        """Sets variables and what follows from them; false if a constraint cannot be met any more."""
        queue = list(first)
        rows = range(len(self.low)) if not first else []
        while True:
            for r in rows:
                terms, b = self.low[r]
                most = sum(c * z[i] if i in z else max(c, 0.0) for i, c in terms)
                if most < b - SLACK:
                    return False
                for i, c in terms:
                    if i not in z and most - abs(c) < b - SLACK:
                        queue.append((i, 1 if c > 0 else 0))
            if not queue:
                return True
            i, value = queue.pop()
            if i in z:
                if z[i] != value:
                    return False
                rows = []
            else:
                z[i] = value
                rows = self.of[i]

    def bound(self, z: dict[int, int]) -> float:
        """No completion of z costs less."""
        total = sum(self.g[i] for i, v in z.items() if v) + sum(min(self.g[i], 0.0) for i in self.rest if i not in z)
        for members, sense, b in self.groups:
            free = [self.g[i] for i in members if i not in z]  # cheapest first
            need = int(np.ceil(b - SLACK)) - sum(z.get(i, 0) for i in members)
            gain = sum(1 for x in free if x < 0)
            take = need if sense == "=" else max(need, gain) if sense == ">=" else min(int(np.floor(b + SLACK)) - sum(z.get(i, 0) for i in members), gain)
            total += sum(free[: max(take, 0)])
        return total

    def run(self) -> dict[int, int] | None:
        """The cheapest point; of equally cheap ones the first, with 0 before 1."""
        best = self._search(lambda i: (0, 1) if self.g[i] >= 0 else (1, 0), np.inf, False)
        if best is None:
            return None
        cost = sum(self.g[i] for i, v in best.items() if v)
        return self._search(lambda i: (0, 1), cost + SLACK, True)

    def _search(self, order, most: float, first: bool) -> dict[int, int] | None:
        start: dict[int, int] = {}
        if not self.fix(start, []):
            return None
        stack, best = [start], None
        while stack:
            z = stack.pop()
            self.left -= 1
            if self.left < 0:
                raise ValueError("a system needs more nodes than most_nodes")
            if self.bound(z) > most:
                continue
            i = next((i for i in self.variables if i not in z), None)
            if i is None:
                best = z
                if first:
                    return best
                most = sum(self.g[i] for i, v in z.items() if v) - SLACK
                continue
            for value in reversed(order(i)):
                child = dict(z)
                if self.fix(child, [(i, value)]):
                    stack.append(child)
        return best


def joined_parts(n: int, rows: list[Row]) -> list[tuple[list[int], list[Row]]]:
    """The variables and rows of each part that constraints join."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for coeffs, _, _ in rows:
        ids = list(coeffs)
        for i in ids[1:]:
            a, b = root(ids[0]), root(i)
            parent[max(a, b)] = min(a, b)
    parts: dict[int, tuple[list[int], list[Row]]] = {}
    for i in range(n):
        parts.setdefault(root(i), ([], []))[0].append(i)
    for r in rows:
        if r[0]:
            parts[root(next(iter(r[0])))][1].append(r)
    return list(parts.values())


class GeneralSystem(System):
    """A system of any number of variables; small ones are enumerated."""

    def __init__(self, n: int, rows: list[Row], most_nodes: int = MOST_NODES):
        super().__init__(n, rows)
        self.most_nodes = most_nodes
        self.parts = joined_parts(n, rows)
        zero = lambda s, b: 0 >= b - SLACK if s == ">=" else 0 <= b + SLACK if s == "<=" else abs(b) <= SLACK
        self.void = any(not c and not zero(s, b) for c, s, b in rows)  # a constraint without variables that does not hold

    def descent_vertex(self, gradient: np.ndarray) -> np.ndarray:
        if self.n <= MAX_VARIABLES:
            return super().descent_vertex(gradient)
        out = np.zeros(self.n)
        for variables, rows in self.parts:
            z = None if self.void else Search(variables, rows, gradient, self.most_nodes).run()
            if z is None:
                raise ValueError("no feasible vertex")
            for i, v in z.items():
                out[i] = v
        return out

    def status(self) -> str:
        try:
            self.descent_vertex(np.zeros(self.n))
        except ValueError as none:
            if "most_nodes" in str(none):
                raise
            return "Infeasible"
        return "Optimal"

    def relaxed_status(self, most_steps: int = 10_000) -> str:
        """Whether a point of the box [0, 1] meets all constraints: phase one of the simplex, with the least index that
        helps (Bland's rule), so that it ends."""
        a = [*self.a, *np.eye(self.n)]
        b, sense = [*self.b, *np.ones(self.n)], [*self.sense, *["<="] * self.n]
        m = len(a)
        slack = np.zeros((m, m))
        for j, s in enumerate(sense):
            slack[j, j] = {"<=": 1.0, ">=": -1.0, "=": 0.0}[s]
        t = np.hstack([np.array(a).reshape(m, self.n), slack, np.array(b, float)[:, None]])
        t[t[:, -1] < 0] *= -1
        own = t[:, :-1].shape[1]
        t = np.hstack([t[:, :-1], np.eye(m), t[:, -1:]])
        basis = list(range(own, own + m))
        cost = -t.sum(0)
        cost[own : own + m] = 0
        for _ in range(most_steps):
            if -cost[-1] <= 1e-7:
                return "Optimal"
            enter = next((j for j in range(own) if cost[j] < -1e-9), None)
            if enter is None:
                return "Infeasible"
            ratios = [(t[i, -1] / t[i, enter], basis[i], i) for i in range(m) if t[i, enter] > 1e-9]
            if not ratios:
                return "Infeasible"
            least = min(r[0] for r in ratios)
            i = min((r for r in ratios if r[0] <= least + 1e-12), key=lambda r: r[1])[2]
            t[i] /= t[i, enter]
            for k in range(m):
                if k != i and t[k, enter]:
                    t[k] -= t[k, enter] * t[i]
            cost = cost - cost[enter] * t[i]
            basis[i] = enter
        raise ValueError("the simplex needs more steps than most_steps")


def gather(terms: DataFrame, constraints: DataFrame, variables: DataFrame) -> DataFrame:
    """One row for each system: group_id, idx and value of its variables in order of idx, rows of (idx, coeff, sense, rhs).
    terms: group_id, c_id, idx, coeff; constraints: group_id, c_id, sense, rhs; variables: group_id, idx, value. Constraints without
    terms stay; a term of an unknown variable is an error of the solver."""
    sides = terms.groupBy("group_id", "c_id").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), F.col("coeff").cast("double").alias("coeff")))).alias("terms"))
    rule = F.struct("c_id", "terms", "sense", F.col("rhs").cast("double").alias("rhs"))
    rules = constraints.join(sides, ["group_id", "c_id"], "left").groupBy("group_id").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    points = variables.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value")))).alias("points"))
    return points.join(rules, "group_id", "left")


def _systems(b: pa.RecordBatch, most_nodes: int):
    """(idx, values, system) of each row of a batch of gather()."""
    for points, rules in zip(b.column("points").to_pylist(), b.column("rules").to_pylist(), strict=True):
        idx = [p["idx"] for p in points]
        place = {i: k for k, i in enumerate(idx)}
        rows = []
        for r in rules or []:
            coeffs: dict[int, float] = {}
            for t in r["terms"] or []:
                coeffs[place[t["idx"]]] = coeffs.get(place[t["idx"]], 0.0) + t["coeff"]
            rows.append((coeffs, r["sense"], r["rhs"]))
        yield idx, np.array([p["value"] for p in points]), GeneralSystem(len(idx), rows, most_nodes)


def _distinct(gathered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group_id, key) of every row of gather(), and the distinct systems (key, points, rules): equal ones are solved once."""
    key = F.sha2(F.to_json(F.struct("points", "rules")), 256).alias("key")
    parts = 4 * gathered.sparkSession.sparkContext.defaultParallelism
    return gathered.select("group_id", key), gathered.select(key, "points", "rules").distinct().repartition(parts)


def _solved(gathered: DataFrame, solve, most_nodes: int) -> DataFrame:
    """group_id, idx, value, z: what solve(values, system) gives for each variable; null where there is no point."""
    keyed, distinct = _distinct(gathered)

    def run(batches):
        for b in batches:
            idx, value, z = [], [], []
            for i, x, system in _systems(b, most_nodes):
                idx.append(i)
                value.append(x.tolist())
                try:
                    z.append(solve(x, system).tolist())
                except ValueError as none:
                    if "most_nodes" in str(none):
                        raise
                    z.append([None] * len(i))
            kinds = (pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(c, k) for c, k in zip((idx, value, z), kinds, strict=True))], names=["key", "idx", "value", "z"])

    out = keyed.hint("merge").join(distinct.mapInArrow(run, "key string, idx array<long>, value array<double>, z array<double>"), "key")
    return out.select("group_id", F.explode(F.arrays_zip("idx", "value", "z")).alias("v")).select("group_id", "v.*")


def descent_vertices(gathered: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """The 0/1 point of each system of least inner product with the values of its variables; the first on ties."""
    return _solved(gathered, lambda x, system: system.descent_vertex(x), most_nodes)


def project(gathered: DataFrame, barrier: bool = True, volatile: bool = False, most_nodes: int = MOST_NODES) -> DataFrame:
    """The prices that lie nearest to the values of the variables among those that the system allows."""
    if barrier:
        return _solved(gathered, lambda x, system: barrier_frank_wolfe(x, system, volatile=volatile), most_nodes)
    return _solved(gathered, frank_wolfe, most_nodes)


def statuses(gathered: DataFrame, relaxed: bool = True, most_nodes: int = MOST_NODES) -> DataFrame:
    """group_id and whether its system has a point of the box or, not relaxed, a 0/1 point."""
    keyed, distinct = _distinct(gathered)

    def run(batches):
        for b in batches:
            out = [s.relaxed_status() if relaxed else s.status() for _, _, s in _systems(b, most_nodes)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.string())], names=["key", "status"])

    return keyed.hint("merge").join(distinct.mapInArrow(run, "key string, status string"), "key").select("group_id", "status")
