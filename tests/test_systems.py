"""General systems against enumeration, communities against the plain greedy method, aggregators against built-in aggregates, the
similarity index against the exact search."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderflow.operators import aggregators, communities, polytope, similarity_index, systems
from ladderflow.operators.vectors import cached_answer, top_similar


def random_system(rng, n, most=5):
    rows = []
    for _ in range(rng.integers(1, most)):
        ids = rng.choice(n, size=rng.integers(1, min(n, 5) + 1), replace=False)
        ones = rng.random() < 0.6
        coeffs = {int(i): 1.0 if ones else float(rng.integers(-3, 4)) for i in ids}
        rows.append((coeffs, str(rng.choice(["<=", ">=", "="])), float(rng.integers(-1, 3))))
    return rows


def enumerated(n, rows, g):
    """The cheapest feasible point, the first on ties, and whether there is one."""
    best = None
    for z in itertools.product((0.0, 1.0), repeat=n):
        ok = True
        for coeffs, sense, b in rows:
            v = sum(c * z[i] for i, c in coeffs.items())
            ok &= v >= b - 1e-9 if sense == ">=" else v <= b + 1e-9 if sense == "<=" else abs(v - b) <= 1e-9
        if ok and (best is None or np.dot(g, z) < best[0] - 1e-9):
            best = (float(np.dot(g, z)), z)
    return best and list(best[1])


@pytest.mark.parametrize("seed", range(40))
def test_branch_and_bound_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 11))
    rows, g = random_system(rng, n), rng.integers(-4, 5, n).astype(float)
    want = enumerated(n, rows, g)
    got = {}
    for variables, own in systems.joined_parts(n, rows):
        z = systems.Search(variables, own, g, 100_000).run()
        got = None if z is None or got is None else {**got, **z}
    void = any(not c for c, _, _ in rows)
    assert void or (got and [float(got[i]) for i in range(n)]) == (want or got) and (got is None) == (want is None)
    system = systems.GeneralSystem(n, rows)
    assert system.status() == ("Optimal" if want else "Infeasible")
    if want:
        assert system.relaxed_status() == "Optimal" and system.descent_vertex(g).tolist() == want


def test_known_optimum_of_forty_variables():
    """Ten markets of four outcomes of which exactly one holds, tied by implications: a chain of tens of constraints whose optimum is
    known, since the cheapest outcomes fit together."""
    rng = np.random.default_rng(4)
    g = rng.integers(1, 50, 40).astype(float)
    best = [int(np.argmin(g[4 * m : 4 * m + 4])) + 4 * m for m in range(10)]
    rows = [({4 * m + k: 1.0 for k in range(4)}, "=", 1.0) for m in range(10)]
    rows += [({best[m + 1]: 1.0, best[m]: -1.0}, ">=", 0.0) for m in range(9)]
    system = systems.GeneralSystem(40, rows)
    assert np.flatnonzero(system.descent_vertex(g)).tolist() == best
    against = [*rows, ({best[0]: 1.0}, "<=", 0.0)]  # now the first market must take its second cheapest outcome
    second = int(np.argsort(g[:4], kind="stable")[1])
    assert np.flatnonzero(systems.GeneralSystem(40, against).descent_vertex(g)).tolist() == sorted([second, *best[1:]])
    with pytest.raises(ValueError, match="most_nodes"):
        systems.GeneralSystem(40, [({i: float(1 + (i * 7) % 5) for i in range(40)}, "=", 61.0)], most_nodes=50).descent_vertex(-g)


def test_fractional_points_make_a_system_feasible():
    odd = [({0: 1.0, 1: 1.0}, "=", 1.0), ({0: 1.0, 1: -1.0}, "=", 0.0)]
    assert (systems.GeneralSystem(2, odd).relaxed_status(), systems.GeneralSystem(2, odd).status()) == ("Optimal", "Infeasible")
    assert systems.GeneralSystem(2, [({0: 1.0, 1: 1.0}, ">=", 2.5)]).relaxed_status() == "Infeasible"
    assert systems.GeneralSystem(1, [({}, ">=", 1.0)]).relaxed_status() == "Infeasible"
    assert systems.GeneralSystem(3, [({0: -2.0, 1: 1.0, 2: 1.0}, "<=", -1.5), ({1: 1.0}, ">=", 0.25)]).relaxed_status() == "Optimal"


def tables(spark, many):
    terms, rules, points = [], [], []
    for group, (n, rows, values) in enumerate(many):
        points += [(group, 10 * i, float(v)) for i, v in enumerate(values)]
        for c, (coeffs, sense, b) in enumerate(rows):
            rules.append((group, c, sense, b))
            terms += [(group, c, 10 * i, x) for i, x in coeffs.items()]
    make = spark.createDataFrame
    return systems.gather(make(terms, "group_id long, c_id int, idx int, coeff double"), make(rules, "group_id long, c_id int, sense string, rhs double"), make(points, "group_id long, idx int, value double"))


@pytest.mark.parametrize("barrier, volatile", [(False, False), (True, False), (True, True)])
def test_projection_of_general_systems(spark, barrier, volatile):
    rng = np.random.default_rng(8)
    many = [(n := int(rng.integers(2, 6)), random_system(rng, n, 3), rng.random(n)) for _ in range(12)]
    many.append((3, [], np.array([0.2, 0.5, 0.9])))
    got = {}
    for r in systems.project(tables(spark, many), barrier, volatile).collect():
        got.setdefault(r.group_id, {})[r.idx // 10] = r.z
    for group, (n, rows, values) in enumerate(many):
        plain = polytope.System(n, rows)
        if not len(plain.vertices()):
            assert set(got[group].values()) == {None}
            continue
        want = polytope.barrier_frank_wolfe(values, plain, volatile=volatile) if barrier else polytope.frank_wolfe(values, plain)
        assert [got[group][i] for i in range(n)] == pytest.approx(want.tolist(), abs=1e-9)


def test_vertices_and_statuses_of_tables(spark):
    rng = np.random.default_rng(9)
    many = [(n := int(rng.integers(1, 8)), random_system(rng, n), rng.integers(-4, 5, n).astype(float)) for _ in range(20)]
    found = {}
    for r in systems.descent_vertices(tables(spark, many)).collect():
        found.setdefault(r.group_id, {})[r.idx // 10] = r.z
    status = {r.group_id: r.status for r in systems.statuses(tables(spark, many), relaxed=False).collect()}
    for group, (n, rows, g) in enumerate(many):
        want = enumerated(n, rows, g)
        assert [found[group][i] for i in range(n)] == (want or [None] * n) and status[group] == ("Optimal" if want else "Infeasible")


def plain_modularity(edges, label):
    total, degree = sum(w for _, _, w in edges) * 2, {}
    for u, v, w in edges:
        degree[u] = degree.get(u, 0) + w
        degree[v] = degree.get(v, 0) + w
    tot = {}
    for n, k in degree.items():
        tot[label[n]] = tot.get(label[n], 0) + k
    return sum(2 * w for u, v, w in edges if label[u] == label[v]) / total - sum((t / total) ** 2 for t in tot.values())


def plain_greedy(edges):
    """Merges the two communities of largest gain until none gains."""
    label = {n: n for e in edges for n in e[:2]}
    q = plain_modularity(edges, label)
    while True:
        best = (q + 1e-12, None)
        for a, b in {tuple(sorted((label[u], label[v]))) for u, v, _ in edges if label[u] != label[v]}:
            merged = {n: a if c == b else c for n, c in label.items()}
            best = max(best, (plain_modularity(edges, merged), (a, b)), key=lambda x: x[0])
        if best[1] is None:
            return q
        q, (a, b) = best
        label = {n: a if c == b else c for n, c in label.items()}


def graphs():
    rng = random.Random(3)
    ring = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "abcde" for i, j in itertools.combinations(range(4), 2)] + [(f"{c}0", f"{d}1", 1.0) for c, d in zip("abcde", "bcdea", strict=True)]
    bipartite = [(f"P{i}", f"X{j}", float(rng.randint(1, 9))) for i in range(12) for j in range(10) if rng.random() < (0.6 if i % 3 == j % 3 else 0.08)]
    sparse = [(str(i), str(j), 1.0) for i, j in itertools.combinations(range(18), 2) if rng.random() < 0.15]
    return {"ring": ring, "bipartite": bipartite, "sparse": sparse, "pair": [("a", "b", 2.0)], "star": [("hub", f"leaf{i}", 1.0) for i in range(6)]}


@pytest.mark.parametrize("name", sorted(graphs()))
def test_communities_are_not_below_the_greedy_ones(spark, name):
    edges = graphs()[name]
    df = spark.createDataFrame([*edges, (None, "z", 1.0), ("y", "x9", 0.0)], "u string, v string, weight double")
    found, q = communities.communities(df)
    label = {r.id: r.community for r in found.collect()}
    assert set(label) == {n for e in edges for n in e[:2]}
    assert q == pytest.approx(plain_modularity(edges, label)) and q >= plain_greedy(edges) - 1e-9
    groups = {}
    for n, c in label.items():
        groups.setdefault(c, set()).add(n)
    assert all(c == min(own) for c, own in groups.items())
    if name == "ring":
        assert {frozenset(g) for g in groups.values()} == {frozenset(f"{c}{i}" for i in range(4)) for c in "abcde"}


def test_a_round_of_moves_joins_the_adjacency_once(spark, monkeypatch):
    """Modularity is not computed by joins of its own: it follows from the table that the next moves are taken from."""
    asked = []
    plain = communities.modularity
    monkeypatch.setattr(communities, "modularity", lambda *a: asked.append(1) or plain(*a))
    edges = graphs()["pair"]
    found, q = communities.communities(spark.createDataFrame(edges, "u string, v string, weight double"))
    assert q == pytest.approx(plain_modularity(edges, {r.id: r.community for r in found.collect()}))
    assert len(asked) <= 1


def test_a_round_of_moves_shuffles_edges_once(spark, monkeypatch):
    """Edges are dealt once for a level and kept; a round sends what they meet to the nodes, and nothing else of their size."""
    plans = []
    plain = communities.written
    monkeypatch.setattr(communities, "written", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, label))
    df = spark.createDataFrame([("a", "b", 2.0)], "u string, v string, weight double")
    adj = communities.adjacency(df)
    degrees = adj.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k"), F.lit(0.0).alias("loop"))
    edges = communities._dealt(adj, degrees, 2)
    communities._state(edges, degrees.withColumn("c", F.col("id")), 4.0, 2)
    edges.unpersist()
    own = plans[0].split("InMemoryRelation")[0]
    assert "InMemoryTableScan" in own and own.count("REPARTITION") == 1


def test_nodes_are_numbered_in_the_order_of_their_ids(spark):
    ids = [f"n{i * 7919 % 1000}" for i in range(1000)]
    adj = spark.createDataFrame([(u, v, 1.0) for u, v in zip(ids, ids[1:] + ids[:1], strict=True)], "u string, v string, w double").repartition(7)
    assert {r.id: r.n for r in communities._numbered(adj).collect()} == {u: n for n, u in enumerate(sorted(ids))}
    assert communities._numbered(adj.limit(0)).collect() == []


def test_communities_of_repeated_edges_loops_and_nothing(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("a", "a", 1.0), ("c", "d", 1.0)], "u string, v string, weight double")
    adj = {(r.u, r.v): r.w for r in communities.adjacency(df).collect()}
    assert adj == {("a", "b"): 3.0, ("b", "a"): 3.0, ("a", "a"): 2.0, ("c", "d"): 1.0, ("d", "c"): 1.0}
    found, _ = communities.communities(df)
    assert {r.id: r.community for r in found.collect()} == {"a": "a", "b": "a", "c": "c", "d": "c"}
    empty, q = communities.communities(df.limit(0))
    assert empty.collect() == [] and q == 0


class Wide(aggregators.Aggregator):
    """Number, sum and the largest of strings by length, as a user might write it."""

    columns, state, output = ["x", "s"], "n long, total long, longest string", "n long, mean double, longest string"

    def zero(self):
        return (0, 0, "")

    def update(self, state, row):
        return self.merge(state, (1, row[0] or 0, row[1] or ""))

    def merge(self, a, b):
        return (a[0] + b[0], a[1] + b[1], max(a[2], b[2], key=lambda t: (len(t), t)))

    def finish(self, state):
        return (state[0], state[1] / state[0], state[2])


@pytest.mark.parametrize("most_keys", [1, 50_000])
def test_aggregator_equals_the_built_in_ones(spark, most_keys):
    """One key holds a third of all rows over many tasks; some keys and values are null; ids are beyond what a double holds."""
    big = (1 << 60) + 1
    k = F.when(F.col("id") % 3 == 0, big).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 7)
    df = spark.range(2_000, numPartitions=25).select(k.alias("k"), F.when(F.col("id") % 11 > 0, F.col("id") + (1 << 40)).alias("x"), F.when(F.col("id") % 13 > 0, F.concat(F.lit("s"), (F.col("id") % 997).cast("string"))).alias("s"))
    got = {r.k: (r.n, r.mean, r.longest) for r in aggregators.aggregate(df, ["k"], Wide(), most_keys).collect()}
    s = F.coalesce("s", F.lit(""))
    built = df.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.coalesce("x", F.lit(0)).cast("decimal(38,0)")).alias("t"), F.max_by(s, F.struct(F.length(s), s)).alias("longest"))
    assert got == {r.k: (r.n, int(r.t) / r.n, r.longest) for r in built.collect()} and big in got and None in got
    assert aggregators.aggregate(df.limit(0), ["k"], Wide()).collect() == []


def test_similarity_index_finds_nine_tenths_and_files_every_row(spark):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(15, 16))
    x = centers[np.arange(1_500) % 15] + rng.normal(0, 0.4, (1_500, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9_000, None), (9_001, [None] * 16), (9_002, [float("nan")] * 16), (None, [1.0] * 16), (9_003, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = df.where("vec_id % 20 = 0")
    exact = top_similar(df.where("vec_id % 20 = 0 AND vec_id < 9000"), df.where("vec_id < 9000"), 5)
    found = similarity_index.indexed_top(asked, df, 5)
    assert similarity_index.recall_of(found, exact) >= 0.9
    sims = {(r.q, r.x): r.sim for r in found.collect()}
    assert all(s == pytest.approx(np.floor(x[q] @ x[y] * 1e4 + 0.5) / 1e4) for (q, y), s in sims.items() if y < 9_000) and all(q != y for q, y in sims)
    data = similarity_index.rows_of(df)
    book = similarity_index.fit(data, 16, 1_501, cells=12)
    index = similarity_index.build(data, book)
    assert index.count() == 1_501
    everything = similarity_index.search(similarity_index.rows_of(asked), index, data, book, 5, probes=12, refine=20, block_rows=100, query_rows=10)
    assert similarity_index.recall_of(everything, exact) >= 0.99
    assert similarity_index.indexed_top(asked, df.limit(0), 5).collect() == []


def test_cache_answers_by_the_index(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, f"h{i % 150}", v.tolist()) for i, v in enumerate(x)], "vec_id long, h string, embedding array<double>")
    asked, cache = df.where("vec_id >= 140"), df.where("vec_id < 140")
    by = lambda how: {r.q: (r.answer, r.kind) for r in cached_answer(asked, cache, 0.4, how).collect()}
    exact, near = by(top_similar), by(lambda q, d, k: similarity_index.indexed_top(q, d, k, recall=1.0, refine=50))
    assert exact == near and {k for _, k in exact.values()} >= {"exact", "semantic"}


def test_equal_systems_are_solved_once(spark):
    """Sixty systems of two kinds, one of them with a negative zero, are two rows for the solver; every group has its result."""
    from ladderflow.operators import systems

    ids = [(g, i) for g in range(60) for i in (1, 2)]
    points = spark.createDataFrame([(g, i, -0.0 if g % 2 else 1.0) for g, i in ids], "group_id long, idx long, value double")
    terms = spark.createDataFrame([(g, 0, i, 1.0) for g, i in ids], "group_id long, c_id int, idx long, coeff double")
    rules = spark.createDataFrame([(g, 0, ">=", 1.0) for g in range(60)], "group_id long, c_id int, sense string, rhs double")
    gathered = systems.gather(terms, rules, points)
    assert systems._distinct(gathered)[1].count() == 2
    assert {tuple(r) for r in systems.statuses(gathered).collect()} == {(g, "Optimal") for g in range(60)}
    assert {(r.group_id, r.idx): r.z for r in systems.descent_vertices(gathered).collect()} == {(g, i): float(i - 1) for g, i in ids}


def test_states_of_an_aggregator_are_no_groups(spark):
    """Merging runs over sorted states, a group for each key took most of the time; a key may be NaN."""
    rows = [(float(i % 3) if i % 4 else float("nan"), f"t{i}", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k double, token_id string, price double").repartition(5)
    found = aggregators.aggregate(df, ["k"], aggregators.MarketPrices(), most_keys=2)
    assert "FlatMapGroups" not in found._jdf.queryExecution().analyzed().toString()
    got = {str(r.k): (r.outcomes, r.total, r.cheapest) for r in found.collect()}
    own = {}
    for k, t, p in rows:
        own.setdefault(str(k), []).append((p, t))
    assert got == {k: (len(x), sum(p for p, _ in x), min(x)[1]) for k, x in own.items()}
