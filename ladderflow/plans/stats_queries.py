"""Queries of statistics, deduplication and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ladderflow.operators import backtest, stats
from ladderflow.operators.arb import top_per_group
from ladderflow.plans.catalog import query
from ladderflow.plans.proxies import MARKETS, TICKS, markets, q, quantise, table, ticks

W = "PARTITION BY key ORDER BY ts, seq"


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else quantise(F.col(c)).alias(c) for c in df.columns])


@query("backtest_metrics", "A10 A13", f"""WITH {TICKS}, t AS (SELECT key AS run_id, value - 50 AS pnl FROM tick) SELECT run_id, {q('sum(pnl)')} AS total, {q('sum(pnl) / 1000 * 100')} AS return_pct, count(*) AS trades,
 {q('CAST(count(*) FILTER (WHERE pnl > 0) AS DOUBLE) / count(*)')} AS win_rate, {q('avg(pnl)')} AS avg_pnl, {q('CASE WHEN count(*) <= 1 OR stddev_samp(pnl) = 0 THEN 0.0 ELSE avg(pnl) / stddev_samp(pnl) END')} AS sharpe, {q('1000 + sum(pnl)')} AS final FROM t GROUP BY 1""")
def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = ticks(spark, sf_dir).select(F.col("key").alias("run_id"), (F.col("value") - 50).alias("pnl"))
    return _rounded(stats.backtest_metrics(trades, 1000.0), "run_id", "trades")


@query("tear_sheet", "A11", f"""WITH {TICKS}, e AS (SELECT key, ts, seq, 100000 + sum(value) OVER ({W} ROWS UNBOUNDED PRECEDING) - 60 * row_number() OVER ({W}) AS equity FROM tick),
 r AS (SELECT *, (equity - lag(equity) OVER ({W})) / lag(equity) OVER ({W}) AS r, max(equity) OVER ({W} ROWS UNBOUNDED PRECEDING) AS peak FROM e)
 SELECT key, {q('CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(362880) ELSE 0.0 END', 4)} AS sharpe, {q('min((equity - peak) / peak)', 8)} AS max_drawdown FROM r GROUP BY 1""")
def tear_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("key").orderBy("ts", "seq")
    equity = 100_000 + F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 60 * F.row_number().over(w)
    rows = stats.tear_sheet(ticks(spark, sf_dir).select("key", "ts", "seq", equity.alias("equity")))
    return rows.select("key", quantise(F.col("sharpe"), 4).alias("sharpe"), quantise(F.col("max_drawdown"), 8).alias("max_drawdown"))


@query("latency_percentiles", "A14", f"""WITH {TICKS}, r AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM tick), l AS (SELECT key, avg(value) AS a, list(value ORDER BY value) AS vs FROM r WHERE rn <= 200 GROUP BY 1)
 SELECT key, {q('a')} AS avg, vs[least(CAST(floor(len(vs) * CAST(0.95 AS DOUBLE)) AS INTEGER), len(vs) - 1) + 1] AS p95, vs[least(CAST(floor(len(vs) * CAST(0.99 AS DOUBLE)) AS INTEGER), len(vs) - 1) + 1] AS p99 FROM l""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.latency(ticks(spark, sf_dir)), "key", "p95", "p99")


@query("node_ranking", "A15", f"""WITH {TICKS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM tick), n AS (SELECT key, avg(value) FILTER (WHERE rn <= 10) AS a, stddev_pop(value) FILTER (WHERE rn <= 10) AS j,
 CAST(avg(CASE WHEN kind <> 'error' THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS rate FROM r GROUP BY 1) SELECT key, {q('a')} AS avg, {q('j')} AS jitter, {q('rate')} AS rate, {q('a * (2 - rate) + 2 * j')} AS score FROM n""")
def node_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.node_ranking(ticks(spark, sf_dir).withColumn("ok", F.col("kind") != "error")), "key")


@query("strategy_breakdown", "A12", """SELECT o_orderpriority AS strategy, count(*) AS n, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS total, floor(avg(o_totalprice) * 100 + 0.5) / 100 AS mean, max(o_totalprice) AS best, min(o_totalprice) AS worst,
 arg_min(o_totalprice, o_orderkey) AS first_value, arg_max(o_totalprice, o_orderkey) AS last_value FROM orders GROUP BY 1""")
def strategy_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("strategy")).agg(
        F.count("*").alias("n"), quantise(F.sum(x), 2).alias("total"), quantise(F.avg(x), 2).alias("mean"), F.max(x).alias("best"), F.min(x).alias("worst"), F.min_by(x, F.col("o_orderkey")).alias("first_value"), F.max_by(x, F.col("o_orderkey")).alias("last_value")
    )


@query("grid_score", "A19 U06", f"""WITH {TICKS}, g AS (SELECT e.e, p.p FROM (VALUES (0.1), (0.3), (0.5)) e(e), (VALUES (20.0), (60.0)) p(p)), r AS (SELECT CAST(e AS DOUBLE) AS edge, CAST(p AS DOUBLE) AS pressure, key, sum(CASE WHEN value > p THEN value * CAST(e AS DOUBLE) - 10 ELSE 0.0 END) AS pnl FROM g, tick GROUP BY 1, 2, 3)
 SELECT edge, pressure, {q('avg(pnl)', 4)} AS mean, {q('avg(pnl) - 0.5 * stddev_samp(pnl)', 4)} AS score FROM r GROUP BY 1, 2""")
def grid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each setting over all keys: the mean less half the deviation. The grid is literal, so the product is small."""
    grid = spark.createDataFrame([(e, p) for e in (0.1, 0.3, 0.5) for p in (20.0, 60.0)], "edge double, pressure double")
    runs = ticks(spark, sf_dir).select("key", "value").crossJoin(F.broadcast(grid))
    pnl = F.sum(F.when(F.col("value") > F.col("pressure"), F.col("value") * F.col("edge") - 10).otherwise(0.0))
    by_key = runs.groupBy("edge", "pressure", "key").agg(pnl.alias("pnl"))
    return by_key.groupBy("edge", "pressure").agg(quantise(F.avg("pnl"), 4).alias("mean"), quantise(F.avg("pnl") - 0.5 * F.stddev_samp("pnl"), 4).alias("score"))


@query("link_scorecard_rollup", "A01 A18 S28", """SELECT coalesce(c_mktsegment, 'ALL') AS exchange, coalesce(o_orderpriority, 'ALL') AS kind, count(*) AS fetched, count(*) FILTER (WHERE o_orderstatus = 'F') AS matched,
 floor(CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(*) * 1e6 + 0.5) / 1e6 AS rate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)""")
def link_scorecard_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    hit = F.count_if(F.col("o_orderstatus") == "F")
    out = rows.rollup("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("fetched"), hit.alias("matched"), quantise(hit / F.count("*")).alias("rate"))
    return out.select(F.coalesce("c_mktsegment", F.lit("ALL")).alias("exchange"), F.coalesce("o_orderpriority", F.lit("ALL")).alias("kind"), "fetched", "matched", "rate")


@query("cache_ratios", "A17", f"""WITH {TICKS}, c AS (SELECT key, count(*) AS n, count(*) FILTER (WHERE kind = 'view') AS exact, count(*) FILTER (WHERE kind = 'click') AS semantic, count(*) FILTER (WHERE kind = 'purchase') AS llm FROM tick GROUP BY 1)
 SELECT key, {q('CAST(exact + semantic AS DOUBLE) / n * 100')} AS hit_rate, {q('(1 - CAST(llm AS DOUBLE) / n) * 100')} AS savings FROM c""")
def cache_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("kind"), F.count("*")
    return ticks(spark, sf_dir).groupBy("key").agg(quantise(stats.ratio(F.count_if(kind.isin("view", "click")), n) * 100).alias("hit_rate"), quantise((1 - stats.ratio(F.count_if(kind == "purchase"), n)) * 100).alias("savings"))


@query("trace_final_status", "A21", """SELECT l_orderkey AS trace_id, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN 'REJECTED' ELSE 'PASSED' END AS final,
 arg_max(l_suppkey, l_linenumber * 1000000 + l_suppkey) FILTER (WHERE l_returnflag = 'R') AS reason, count(*) AS steps FROM lineitem GROUP BY 1""")
def trace_final_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    steps = line.select(F.col("l_orderkey").alias("trace_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("step_no"), F.when(F.col("l_returnflag") == "R", "FAIL").otherwise("PASS").alias("status"), F.col("l_suppkey").alias("reason"))
    return stats.final_status(steps)


@query("net_exposure", "A20", """SELECT l_partkey AS market, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS yes, sum(CASE WHEN l_linestatus <> 'O' THEN l_quantity ELSE 0 END) AS no,
 sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END) AS exposure FROM lineitem GROUP BY 1""")
def net_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes, x = F.col("l_linestatus") == "O", F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("market")).agg(F.sum(F.when(yes, x).otherwise(0.0)).alias("yes"), F.sum(F.when(yes, 0.0).otherwise(x)).alias("no"), F.sum(F.when(yes, x).otherwise(-x)).alias("exposure"))


@query("dedupe_max_confidence", "A05", """WITH d AS (SELECT lower(p_name) AS slug, p_partkey, p_retailprice, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) SELECT slug, p_partkey, p_retailprice FROM d WHERE rn = 1""")
def dedupe_max_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.lower("p_name").alias("slug"), "p_partkey", "p_retailprice")
    return top_per_group(rows, "slug", [F.desc("p_retailprice"), "p_partkey"])


@query("dedupe_first_wins", "U02 S02 U01", """WITH u AS (SELECT 0 AS src, l_partkey AS id, l_suppkey AS pos, l_orderkey AS v FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT 1, l_partkey, l_suppkey, l_orderkey FROM lineitem WHERE l_linestatus <> 'O'),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, pos, v) AS rn FROM u) SELECT id, src, pos, v FROM r WHERE rn = 1""")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    part = lambda src, cond: line.where(cond).select(F.lit(src).alias("src"), F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("pos"), F.col("l_orderkey").alias("v"))
    rows = part(0, "l_linestatus = 'O'").unionByName(part(1, "l_linestatus <> 'O'"))
    return top_per_group(rows, "id", ["src", "pos", "v"])


@query("alias_union", "U03 U05", """WITH a AS (SELECT l_suppkey AS canonical, list_sort(list(DISTINCT l_shipdate::DATE::VARCHAR) FILTER (WHERE l_returnflag = 'A')) AS a, list_sort(list(DISTINCT l_shipdate::DATE::VARCHAR) FILTER (WHERE l_returnflag <> 'A')) AS b FROM lineitem GROUP BY 1)
 SELECT canonical, len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) AS merged, len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS only_first FROM a""")
def alias_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("l_shipdate").cast("string")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("canonical")).agg(F.collect_set(F.when(F.col("l_returnflag") == "A", day)).alias("a"), F.collect_set(F.when(F.col("l_returnflag") != "A", day)).alias("b"))
    return rows.select("canonical", F.size(F.array_union("a", "b")).cast("long").alias("merged"), F.size(F.array_except("a", "b")).cast("long").alias("only_first"))


@query("market_quality_topn", "P03 P04 P05 L01", f"""WITH {MARKETS}, s AS (SELECT market_id, volume, liquidity, abs(1 - (CAST(market_id % 50 AS DOUBLE) / 100 + 0.5)) * 100 AS spread FROM market WHERE volume >= 1000 AND liquidity >= 100 AND status <> 'P')
 SELECT market_id, {q('spread')} AS spread, {q('least(volume / 100000, 1) * 40 + least(liquidity / 50000, 1) * 30 + greatest(0, (10 - spread) / 10) * 20 + 10')} AS score FROM s ORDER BY score DESC, market_id LIMIT 100""")
def market_quality_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score uses the true spread of each market."""
    spread = F.abs(1 - ((F.col("market_id") % 50) / 100 + 0.5)) * 100
    rows = markets(spark, sf_dir).where("volume >= 1000 and liquidity >= 100 and status <> 'P'").withColumn("spread", spread)
    score = F.least(F.col("volume") / 100_000, F.lit(1.0)) * 40 + F.least(F.col("liquidity") / 50_000, F.lit(1.0)) * 30 + F.greatest(F.lit(0.0), (10 - F.col("spread")) / 10) * 20 + 10
    return rows.select("market_id", quantise(F.col("spread")).alias("spread"), quantise(score).alias("score")).orderBy(F.desc("score"), "market_id").limit(100)


@query("market_discard_reasons", "P01 P02", f"""WITH {MARKETS} SELECT CASE WHEN market_id % 17 = 0 THEN 'no_date' WHEN ts < TIMESTAMP '1996-01-01' THEN 'expired' WHEN category NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'category' WHEN status = 'P' THEN 'tokens' ELSE 'kept' END AS reason, count(*) AS n FROM market GROUP BY 1""")
def market_discard_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("market_id") % 17 == 0, "no_date").when(F.col("ts") < F.lit("1996-01-01").cast("timestamp_ntz"), "expired").when(~F.col("category").isin("BUILDING", "MACHINERY", "AUTOMOBILE"), "category").when(F.col("status") == "P", "tokens").otherwise("kept")
    return markets(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("market_predicates", "P06 P07 P08 P12 P16 P19 P23", f"""WITH {MARKETS} SELECT market_id, CAST(market_id % 30 AS INTEGER) < 24 AS within_24h, market_id % 13 = 0 OR market_id % 30 <= 12 AS within_12h, CAST(market_id % 6 AS INTEGER) <= 2 AS same_day,
 NOT (category = 'BUILDING' AND market_id % 3 = 2) AS runners_ok, least(volume, liquidity) >= 500 AS liquid, abs(volume / 500000 - liquidity / 10000) <= 0.2 AS consistent,
 CASE WHEN liquidity / 10000 >= 0.75 THEN 'auto' WHEN liquidity / 10000 >= 0.6 THEN 'medium' ELSE 'weak' END AS triage FROM market""")
def market_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ladderflow.functions import predicates as P

    k = F.col("market_id")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    later = F.timestamp_micros(F.unix_micros(base) + k % 30 * 3_600_000_000)
    unknown = F.when(k % 13 == 0, F.lit(None).cast("timestamp")).otherwise(later)
    return markets(spark, sf_dir).select(
        "market_id", P.within_day(base, later).alias("within_24h"), P.within_hours(base, unknown).alias("within_12h"), P.same_day(base, F.timestamp_micros(F.unix_micros(base) + k % 6 * 86_400_000_000)).alias("same_day"),
        P.runners_ok(F.lit("WINNER"), F.when(k % 3 == 2, 2).otherwise(3), F.when(F.col("category") == "BUILDING", "1").otherwise("2")).alias("runners_ok"), P.liquid(F.col("volume"), F.col("liquidity"), 500.0).alias("liquid"),
        P.consistent(F.col("volume") / 500_000, F.col("liquidity") / 10_000).alias("consistent"), P.triage(F.col("liquidity") / 10_000).alias("triage"),
    )


@query("leaderboard", "L08 S26 L07", """WITH w AS (SELECT c_custkey AS wallet, sum(o_totalprice) AS vol, max(c_acctbal) AS pnl FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT wallet, pnl, floor(vol * 100 + 0.5) / 100 AS vol FROM w WHERE pnl >= 5000 AND vol >= 10000 ORDER BY pnl DESC, wallet LIMIT 10""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_custkey").alias("wallet")).agg(F.sum("o_totalprice").alias("vol"), F.max("c_acctbal").alias("pnl"))
    return rows.where("pnl >= 5000 and vol >= 10000").select("wallet", "pnl", quantise(F.col("vol"), 2).alias("vol")).orderBy(F.desc("pnl"), "wallet").limit(10)


@query("bounded_history", "L11 T15 T20", f"""WITH {TICKS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM tick) SELECT key, count(*) FILTER (WHERE rn <= 20) AS kept, count(*) FILTER (WHERE rn > 20) AS dropped, min(seq) FILTER (WHERE rn <= 20) AS oldest FROM r GROUP BY 1""")
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("seq")))
    rows = ticks(spark, sf_dir).withColumn("rn", rn)
    return rows.groupBy("key").agg(F.count_if(F.col("rn") <= 20).alias("kept"), F.count_if(F.col("rn") > 20).alias("dropped"), F.min(F.when(F.col("rn") <= 20, F.col("seq"))).alias("oldest"))


@query("metrics_histogram", "K09", """SELECT event_type AS kind, count(*) FILTER (WHERE value <= 10) AS le_10, count(*) FILTER (WHERE value <= 50) AS le_50, count(*) FILTER (WHERE value <= 100) AS le_100, count(*) FILTER (WHERE value <= 500) AS le_500, count(*) AS le_inf,
 floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY 1""")
def metrics_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative buckets, as a metrics registry keeps them."""
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(*[F.count_if(v <= b).alias(f"le_{b}") for b in (10, 50, 100, 500)], F.count("*").alias("le_inf"), quantise(F.sum(v), 2).alias("total"))


@query("api_breaker", "T11", None)
def api_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = ticks(spark, sf_dir).select("seq", "ts", "key", (F.col("value") > 30).alias("ok"))
    return backtest.api_breaker(calls, 3, 5 * 86_400.0)
