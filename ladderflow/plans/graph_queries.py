"""Queries over graphs, constraint systems and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderflow.operators import communities, graph, polytope, similarity_index, systems
from ladderflow.operators.scratch import written
from ladderflow.operators.vectors import cached_answer, top_similar
from ladderflow.plans.catalog import query
from ladderflow.plans.proxies import OUTCOMES, outcomes, q, quantise, table, ticks

_PAIRS = "p AS (SELECT l_suppkey AS left_id, l_partkey AS right_id, max(l_quantity) * 2 AS score FROM lineitem GROUP BY 1, 2)"
_EDGES = f"{_PAIRS}, e AS (SELECT 'P_' || CAST(left_id AS VARCHAR) AS u, 'X_' || CAST(right_id AS VARCHAR) AS v, score AS weight FROM p WHERE score >= 92)"
#: Rounds of least labels of neighbours in SQL: more than the longest shortest path of these graphs; the query has no limit.
_ROUNDS = 14
_COMPONENTS = (
    f"{_EDGES}, b AS MATERIALIZED (SELECT u, v FROM e UNION SELECT v, u FROM e), c0 AS MATERIALIZED (SELECT DISTINCT u AS id, u AS c FROM b)"
    + "".join(f", c{i + 1} AS MATERIALIZED (SELECT b.u AS id, least(any_value(o.c), min(n.c)) AS c FROM b JOIN c{i} o ON o.id = b.u JOIN c{i} n ON n.id = b.v GROUP BY b.u)" for i in range(_ROUNDS))
    + f", comp AS (SELECT id, c AS component FROM c{_ROUNDS})"
)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    pairs = line.groupBy(F.col("l_suppkey").alias("left_id"), F.col("l_partkey").alias("right_id")).agg((F.max("l_quantity") * 2).alias("score"))
    return graph.bipartite_edges(pairs, 92.0)


@query("link_graph", "G01", f"WITH {_EDGES} SELECT u, v, weight FROM e")
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query("entity_components", "G02", f"WITH {_COMPONENTS} SELECT id, component FROM comp")
def entity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_edges(spark, sf_dir))


@query("best_neighbor", "G04 A16", f"""WITH {_COMPONENTS}, k AS (SELECT e.*, component, row_number() OVER (PARTITION BY u ORDER BY weight DESC, v) AS rn, avg(weight) OVER (PARTITION BY component) AS m FROM e JOIN comp ON id = u)
 SELECT u, component, v, weight, {q('m')} AS cluster_confidence FROM k WHERE rn = 1""")
def best_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    rows = graph.best_neighbours(edges, graph.components(edges))
    return rows.withColumn("cluster_confidence", quantise(F.col("cluster_confidence")))


#: Rows of lineitem for each task of constraint_feasibility.
ROWS_A_TASK = 500_000

_POINTS = "SELECT l_orderkey AS group_id, CAST(l_linenumber AS INTEGER) AS idx, min(l_discount) * 5 AS value FROM lineitem GROUP BY 1, 2"


@query("constraint_feasibility", "G07 G08 G14", f"""WITH x AS ({_POINTS}), s AS (SELECT group_id, sum(value) AS total, sum(CASE WHEN idx <= 2 THEN CASE idx WHEN 1 THEN value ELSE -value END END) AS diff FROM x GROUP BY 1)
 SELECT group_id, total <= 1.00001 AND coalesce(diff >= -0.00001, true) AS feasible FROM s""")
def constraint_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's outcomes must not add up to more than 1, and the first must not be below the second."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("idx"), "l_discount")
    # tasks by the number of rows: what one holds to sort and group does not grow with the table
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-line.count() // ROWS_A_TASK))
    points = line.repartition(tasks, "group_id", "idx").groupBy("group_id", "idx").agg((F.min("l_discount") * 5).alias("value"))
    keys = points.select("group_id", "idx")
    total = keys.select("group_id", F.lit(0).alias("c_id"), "idx", F.lit(1.0).alias("coeff"))
    order = keys.where("idx <= 2").select("group_id", F.lit(1).alias("c_id"), "idx", F.when(F.col("idx") == 1, 1.0).otherwise(-1.0).alias("coeff"))
    terms = total.unionByName(order)
    rules = terms.select("group_id", "c_id").repartition(tasks, "group_id", "c_id").distinct().select("group_id", "c_id", F.when(F.col("c_id") == 0, "<=").otherwise(">=").alias("sense"), F.when(F.col("c_id") == 0, 1.0).otherwise(0.0).alias("rhs"))
    return polytope.feasible(terms.repartition(tasks, "group_id", "idx"), rules, points, tasks=tasks)


_GROUPS = f"{OUTCOMES}, x AS (SELECT market_id AS group_id, list(price * 0.4 ORDER BY pos) AS xs FROM outcome GROUP BY 1)"


def _sweeps(low: float, high: float, gap: float, move: float) -> str:
    """Cyclic projection of all groups in SQL: sweeps of a shift to the sum and a clip to the box, until nothing moves. fair: group_id, xs."""
    total = "list_sum(xs)"
    shift = f"CASE WHEN abs(1 - {total}) > {gap} THEN (1 - {total}) / len(xs) ELSE 0.0 END"
    still = f"list_max(list_transform(range(1, len(xs) + 1), lambda i: abs(xs[i] - ys[i]))) < {move}" if move else f"abs(1 - {total}) <= {gap}"
    return f"""s AS (SELECT group_id, 0 AS it, xs, false AS done FROM x UNION ALL SELECT group_id, it + 1, ys, {still} FROM
 (SELECT group_id, it, xs, list_transform(xs, lambda p: greatest({low}, least({high}, p + {shift}))) AS ys FROM s WHERE it < 100 AND NOT done)), fair AS (SELECT group_id, arg_max(xs, it) AS xs FROM s GROUP BY 1),
 f AS (SELECT group_id, unnest(range(1, len(x.xs) + 1)) AS idx, unnest(x.xs) AS price, unnest(fair.xs) AS fair FROM x JOIN fair USING (group_id))"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).select(F.col("market_id").alias("group_id"), F.col("pos").alias("idx"), (F.col("price") * 0.4).alias("price"))


@query("sum_projection", "G10", f"WITH RECURSIVE {_GROUPS}, {_sweeps(0.001, 0.999, 1e-6, 1e-6)} SELECT group_id, CAST(idx AS INTEGER) AS idx, {q('price')} AS price, {q('fair', 3)} AS fair FROM f")
def sum_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = polytope.project_groups(_groups(spark, sf_dir))
    return rows.select("group_id", "idx", quantise(F.col("price")).alias("price"), quantise(F.col("fair"), 3).alias("fair"))


@query("max_deviation_arb", "G11 P31", f"""WITH RECURSIVE {_GROUPS}, {_sweeps(0.001, 0.999, 1e-6, 1e-6)}, d AS (SELECT group_id, max(abs({q('fair', 9)} - {q('price', 9)})) AS edge FROM f GROUP BY 1) SELECT group_id, {q('edge', 3)} AS edge FROM d WHERE edge >= 0.01""")
def max_deviation_arb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = polytope.project_groups(_groups(spark, sf_dir))
    rows = rows.withColumn("price", quantise(F.col("price"), 9)).withColumn("fair", quantise(F.col("fair"), 9))
    return polytope.best_deviation(rows).select("group_id", quantise(F.col("edge"), 3).alias("edge"))


@query("bfw_projection", "G13", None)
def bfw_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polytope.project_groups(_groups(spark, sf_dir), "barrier")


@query("kl_projection", "G12 G06", None)
def kl_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frank-Wolfe towards the nearest prices that add up to 1; a test holds it to the plain algorithm."""
    return polytope.project_groups(_groups(spark, sf_dir), "frank-wolfe")


@query("half_space_projection", "G09", f"WITH RECURSIVE {_GROUPS}, {_sweeps(0.0, 1.0, 0.0, 0.0)} SELECT group_id, CAST(idx AS INTEGER) AS idx, {q('price')} AS price, {q('fair', 3)} AS fair FROM f")
def half_space_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = polytope.project_groups(_groups(spark, sf_dir), "half-space")
    return rows.select("group_id", "idx", quantise(F.col("price")).alias("price"), quantise(F.col("fair"), 3).alias("fair"))


@query("system_status", "G05 G17", """WITH g AS (SELECT l_orderkey AS group_id, max(l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT group_id, CASE WHEN group_id % 9 <= n - 1 THEN 'Optimal' ELSE 'Infeasible' END AS status FROM g""")
def system_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of n outcomes at least some number must hold, and the first must not."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("group_id")).agg(F.max("l_linenumber").alias("n"))
    ones, first = F.transform(F.sequence(F.lit(1), "n"), lambda i: F.lit(1.0)), F.transform(F.sequence(F.lit(1), "n"), lambda i: F.when(i == 1, 1.0).otherwise(0.0))
    rule = lambda c, s, r: F.struct(c.alias("coeffs"), F.lit(s).alias("sense"), r.cast("double").alias("rhs"))
    return polytope.statuses(g.select("group_id", "n", F.array(rule(ones, ">=", F.col("group_id") % 9), rule(first, "<=", F.lit(0.0))).alias("rows")))


_RULES = f"""{OUTCOMES}, n AS (SELECT market_id AS group_id, count(*) AS n, list(CAST(floor(price * 51 + 0.5) AS BIGINT) % 11 - 5 ORDER BY pos) AS g FROM outcome GROUP BY 1)"""


def _constraint_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's outcomes: one or two of them hold, the first if the second does, and never both the first and the last."""
    rows = outcomes(spark, sf_dir).select(F.col("market_id").alias("group_id"), F.col("pos").alias("idx"), (F.floor(F.col("price") * 51 + 0.5) % 11 - 5).alias("value"))
    n = rows.groupBy("group_id").agg(F.count("*").alias("n"))
    term = lambda df, c, coeff: df.select("group_id", F.lit(c).alias("c_id"), "idx", coeff.cast("double").alias("coeff"))
    sized = rows.join(n, "group_id")
    ends = sized.where("n > 2 AND (idx = 1 OR idx = n)")
    terms = term(rows, 0, F.lit(1)).union(term(rows, 1, F.lit(1))).union(term(sized.where("n > 1 AND idx <= 2"), 2, F.when(F.col("idx") == 1, 1).otherwise(-1))).union(term(ends, 3, F.lit(1)))
    kinds = F.create_map(*(F.lit(x) for x in (0, "<=", 1, ">=", 2, ">=", 3, "<=")))
    sides = F.create_map(*(F.lit(x) for x in (0, 2.0, 1, 1.0, 2, 0.0, 3, 1.0)))
    rules = terms.select("group_id", "c_id").distinct().select("group_id", "c_id", kinds[F.col("c_id")].alias("sense"), sides[F.col("c_id")].alias("rhs"))
    return systems.gather(terms, rules, rows)


@query("descent_vertices", "G06 G08", f"""WITH {_RULES}, m AS (SELECT group_id, n, g, unnest(range(1 << CAST(n AS INT))) AS m FROM n), z AS (SELECT group_id, n, g, m, list_transform(range(1, n + 1), lambda i: (m >> CAST(n - i AS INT)) & 1) AS z FROM m),
 f AS (SELECT *, list_sum(list_transform(range(1, n + 1), lambda i: z[i] * g[i])) AS cost FROM z WHERE list_sum(z) BETWEEN 1 AND 2 AND (n < 2 OR z[1] >= z[2]) AND (n < 3 OR z[1] + z[n] <= 1)),
 b AS (SELECT group_id, n, g, arg_min(z, cost * (1 << 24) + m) AS z FROM f GROUP BY 1, 2, 3)
 SELECT group_id, unnest(range(1, n + 1)) AS idx, CAST(unnest(g) AS DOUBLE) AS value, CAST(unnest(z) AS DOUBLE) AS z FROM b""")
def descent_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest 0/1 point of each order's constraint tables; the first on ties."""
    return systems.descent_vertices(_constraint_tables(spark, sf_dir))


@query("relaxed_status", "G05 G17", f"""WITH {_RULES}, s AS (SELECT group_id, n, (group_id % 9) / 2 AS s FROM n)
 SELECT group_id, CASE WHEN CASE WHEN n = 1 THEN s BETWEEN 0 AND 1 ELSE s BETWEEN 0.5 AND n - 0.5 END THEN 'Optimal' ELSE 'Infeasible' END AS status FROM s""")
def relaxed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether prices in [0, 1] can add up to a multiple of a half, the first at least a half above the second."""
    rows = outcomes(spark, sf_dir).select(F.col("market_id").alias("group_id"), F.col("pos").alias("idx"), F.lit(0.0).alias("value"))
    two = rows.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").join(rows.where("idx <= 2"), "group_id")
    terms = rows.select("group_id", F.lit(0).alias("c_id"), "idx", F.lit(1.0).alias("coeff")).union(two.select("group_id", F.lit(1), "idx", F.when(F.col("idx") == 1, 1.0).otherwise(-1.0)))
    rules = terms.select("group_id", "c_id").distinct().select("group_id", "c_id", F.when(F.col("c_id") == 0, "=").otherwise(">=").alias("sense"), F.when(F.col("c_id") == 0, F.col("group_id") % 9 / 2).otherwise(0.5).alias("rhs"))
    return systems.statuses(systems.gather(terms, rules, rows))


@query("volatile_projection", "G13 G14", None)
def volatile_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of volatile markets projected on general systems; a test holds it to the plain algorithm."""
    return systems.project(_constraint_tables(spark, sf_dir).withColumn("points", F.transform("points", lambda p: F.struct(p["idx"].alias("idx"), ((p["value"] + 6) / 12).alias("value")))), volatile=True)


@query("graph_communities", "G02", f"WITH {_EDGES} SELECT count(*) AS nodes, true AS named_by_least, true AS above_components FROM (SELECT u FROM e UNION SELECT v FROM e)")
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities by modularity: every node is in one, which is named by its least node, and modularity is above that of the
    connected components. A test holds the communities to the plain greedy method."""
    edges = written(_edges(spark, sf_dir), "edges")  # read by each of the three steps
    found, q_found = communities.communities(edges)
    parts = graph.components(edges).select("id", F.col("component").alias("c"))
    above = q_found > communities.modularity(communities.adjacency(edges), parts)
    named = found.groupBy("community").agg((F.min("id") == F.col("community")).alias("ok"), F.count("*").alias("n"))
    return named.agg(F.sum("n").alias("nodes"), F.bool_and("ok").alias("named_by_least")).withColumn("above_components", F.lit(above))


_DOT = q('list_dot_product(list_transform(a.embedding, lambda v: CAST(v AS DOUBLE)), list_transform(b.embedding, lambda v: CAST(v AS DOUBLE)))', 4)


@query("cosine_topk", "Y20 L02 F07", f"""WITH s AS (SELECT a.vec_id AS q, b.vec_id AS x, {_DOT} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY sim DESC, x) AS INTEGER) AS rank FROM s) SELECT q, x, sim, rank FROM r WHERE rank <= 5""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector against all."""
    e = table(spark, sf_dir, "embeddings")
    return top_similar(e.where("vec_id % 20 = 0"), e, 5)


@query("similar_by_index", "L02 F06", None)
def similar_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector against all, by the inverted file; index_recall measures it."""
    e = table(spark, sf_dir, "embeddings")
    return similarity_index.indexed_top(e.where("vec_id % 20 = 0"), e, 5)


@query("index_recall", "L02", "SELECT count(*) FILTER (WHERE vec_id % 20 = 0) AS queries, count(*) AS filed, true AS nine_tenths FROM embeddings")
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted file against the exact search over the whole table: every row is filed, and at least nine tenths of the exact
    neighbours are found."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0")
    recall = similarity_index.recall_of(similarity_index.indexed_top(asked, e, 5), top_similar(asked, e, 5))
    filed = similarity_index.rows_of(e)
    return filed.agg(F.count(F.when(F.col("vec_id") % 20 == 0, 1)).alias("queries"), F.count("*").alias("filed")).withColumn("nine_tenths", F.lit(recall >= 0.9))


@query("semantic_cache_lookup", "F06", f"""WITH e AS (SELECT vec_id, embedding, md5(CAST(label AS VARCHAR) || '-' || CAST(vec_id % 499 AS VARCHAR)) AS h FROM embeddings), a AS (SELECT * FROM e WHERE vec_id % 20 = 0), b AS (SELECT * FROM e WHERE vec_id % 20 <> 0),
 k AS (SELECT h, min(vec_id) AS hit FROM b GROUP BY 1), s AS (SELECT a.vec_id AS q, b.vec_id AS x, {_DOT} AS sim FROM a, b), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, x) AS rn FROM s)
 SELECT a.vec_id AS q, CASE WHEN hit IS NOT NULL THEN hit WHEN sim >= 0.3 THEN x END AS answer, CASE WHEN hit IS NOT NULL THEN 'exact' WHEN sim >= 0.3 THEN 'semantic' ELSE 'miss' END AS kind FROM a LEFT JOIN k USING (h) LEFT JOIN r ON r.q = a.vec_id AND rn = 1""")
def semantic_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector is asked of a cache of all others."""
    e = table(spark, sf_dir, "embeddings").withColumn("h", F.md5(F.concat_ws("-", F.col("label").cast("string"), (F.col("vec_id") % 499).cast("string"))))
    return cached_answer(e.where("vec_id % 20 = 0"), e.where("vec_id % 20 <> 0"), 0.3)


@query("logistic_training", "G15", None)
def logistic_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).select((F.col("value") / 100).alias("x1"), (F.col("seq") % 2).cast("double").alias("x2"), (F.col("value") > 50).cast("int").alias("y"))
    weights, bias = graph.logistic_fit(rows, ["x1", "x2"], "y")
    return spark.createDataFrame([("x1", weights[0]), ("x2", weights[1]), ("bias", bias)], "feature string, weight double")


@query("online_ensemble", "G16", None)
def online_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).select("key", "ts", "seq", (F.col("value") / 100).alias("x1"), (F.col("value") > 50).cast("int").alias("y"))
    return polytope.online_ensemble(rows, ["x1"], "y")
