"""Queries over running risk limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderflow.operators import backtest, risk
from ladderflow.plans.catalog import query
from ladderflow.plans.proxies import BOOK, TICKS, book_levels, q, quantise, table, ticks

W = "PARTITION BY key ORDER BY ts, seq"


@query("breaker_latch_daily", "T06 T22", f"""WITH {TICKS}, d AS (SELECT *, CAST(ts AS DATE) AS day FROM tick), r AS (SELECT seq, day, ts, count(*) OVER w AS attempts, CAST(sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER w AS DOUBLE) / count(*) OVER w AS rate
 FROM d WINDOW w AS (PARTITION BY day ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)) SELECT seq, attempts, {q('rate')} AS rate,
 max(CASE WHEN attempts >= 10 AND rate > 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) = 1 AS tripped FROM r""")
def breaker_latch_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = risk.breaker_by_day(ticks(spark, sf_dir), F.col("kind") == "error")
    return rows.select("seq", "attempts", quantise(F.col("rate")).alias("rate"), "tripped")


@query("capital_breaker", "T06 T22", f"""WITH {TICKS}, d AS (SELECT *, CAST(ts AS DATE) AS day, CASE WHEN seq % 97 = 0 THEN 0.0 ELSE 1000 + value / 10 END AS balance FROM tick), s AS (SELECT *, first_value(balance) OVER (PARTITION BY day ORDER BY ts, seq) AS start FROM d)
 SELECT seq, balance, max(CASE WHEN balance < 10 OR (start > 0 AND (start - balance) / start > 0.05) THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) = 1 AS broken FROM s""")
def capital_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("seq") % 97 == 0, "invalid").otherwise((1000 + F.col("value") / 10).cast("string"))
    rows = risk.capital_breaker(ticks(spark, sf_dir), risk.validated_balance(raw))
    return rows.select("seq", "balance", "broken")


@query("error_burst_60s", "T09", f"""WITH {TICKS}, r AS (SELECT seq, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent FROM tick) SELECT seq, recent, recent >= 2 AS blocked FROM r""")
def error_burst_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic ticks are sparse, so the window is a day here; the rule is the same."""
    return risk.burst(ticks(spark, sf_dir), F.col("kind") == "error", 86_400, 2).select("seq", "recent", "blocked")


@query("guardian_pauses", "T10 W10", f"""WITH {TICKS}, i AS (SELECT *, value - 50 AS pnl, sum(CASE WHEN value - 50 < 0 THEN 0 ELSE 1 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS island FROM tick),
 s AS (SELECT *, sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key, island ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS streak, 1000 + sum(pnl) OVER ({W} ROWS UNBOUNDED PRECEDING) AS balance FROM i),
 p AS (SELECT *, greatest(1000 - balance, 0) / 1000 AS drawdown FROM s) SELECT seq, streak, {q('drawdown')} AS drawdown,
 max(CASE WHEN drawdown > 0.1 OR streak >= 5 THEN ts + INTERVAL 60 MINUTE END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS pause_until FROM p""")
def guardian_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = risk.guardian(ticks(spark, sf_dir), F.col("value") - 50, 1000.0)
    return rows.select("seq", "streak", quantise(F.col("drawdown")).alias("drawdown"), "pause_until")


@query("daily_notional_limit", "T12", f"""WITH {TICKS}, d AS (SELECT *, CAST(ts AS DATE) AS day, value AS notional, value - 60 AS pnl FROM tick), u AS (SELECT *, coalesce(sum(abs(notional)) OVER w, 0) AS used, coalesce(sum(greatest(-pnl, 0)) OVER w, 0) AS lost FROM d
 WINDOW w AS (PARTITION BY key, day ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT seq, {q('used')} AS used, {q('lost')} AS lost,
 CASE WHEN abs(notional) > 150 THEN 'size' WHEN lost >= 40 THEN 'daily_loss_limit' WHEN used + abs(notional) > 200 THEN 'daily_notional' END AS reason FROM u""")
def daily_notional_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = risk.daily_limits(ticks(spark, sf_dir), F.col("value"), F.col("value") - 60, 150.0, 200.0, 40.0)
    return rows.select("seq", quantise(F.col("used")).alias("used"), quantise(F.col("lost")).alias("lost"), "reason")


@query("feed_staleness", "T14", f"""WITH {TICKS}, l AS (SELECT key, max(ts) AS last FROM tick GROUP BY 1), n AS (SELECT max(ts) AS now FROM tick)
 SELECT key, {q('CAST(epoch_us(now) - epoch_us(last) AS DOUBLE) / 1e6')} AS age, CAST(epoch_us(now) - epoch_us(last) AS DOUBLE) / 1e6 <= 86400 AS healthy FROM l, n""")
def feed_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    now = t.agg(F.max("ts").alias("now"))
    rows = risk.staleness(t, F.lit(now.first()["now"]), 86_400.0)
    return rows.select("key", quantise(F.col("age")).alias("age"), "healthy")


@query("operational_breaker", "T13 T11", f"""WITH {TICKS}, k AS (SELECT key, CAST(avg(CASE WHEN kind = 'error' THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS err, floor(avg(value) * 1e6 + 0.5) / 1e6 AS m FROM tick GROUP BY 1)
 SELECT key, nullif(concat_ws(',', CASE WHEN err >= 0.05 THEN 'error_rate' END, CASE WHEN m * 5 >= 250 THEN 'latency' END, CASE WHEN m >= 90 THEN 'volatility' END), '') AS reason FROM k""")
def operational_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).groupBy("key").agg(F.avg(F.when(F.col("kind") == "error", 1.0).otherwise(0.0)).alias("err"), quantise(F.avg("value")).alias("m"))
    return rows.select("key", risk.operational(F.col("m"), F.lit(45.0), F.col("err"), F.col("m") * 5).alias("reason"))


@query("leg_outcomes", "B07 B08", """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN a AND b THEN 'BOTH' WHEN NOT a AND NOT b THEN 'NONE' WHEN a THEN 'LEGGED_PRIMARY' ELSE 'LEGGED_HEDGE' END AS state,
 CASE WHEN a <> b THEN -l_quantity * 0.02 ELSE 0.0 END AS pnl FROM (SELECT *, l_returnflag <> 'R' AS a, l_linestatus = 'O' AS b FROM lineitem)""")
def leg_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = risk.leg_outcome(F.col("l_returnflag") != "R", F.col("l_linestatus") == "O", F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", out.alias("o")).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "o.state", "o.pnl")


@query("recovery_plan", "B09", """SELECT l_orderkey AS strategy_id, l_linenumber AS leg, CASE WHEN l_returnflag = 'R' THEN 'RETRY' ELSE 'LIQUIDATE' END AS action,
 CASE WHEN l_returnflag = 'R' THEN s ELSE CASE WHEN s = 'BUY' THEN 'SELL' ELSE 'BUY' END END AS order_side, CASE WHEN l_returnflag = 'R' THEN CASE WHEN s = 'BUY' THEN 1.0 ELSE 0.0 END END AS limit_price
 FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS s FROM lineitem)""")
def recovery_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    legs = line.select(F.col("l_orderkey").alias("strategy_id"), F.col("l_linenumber").alias("leg"), F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"), (F.col("l_returnflag") != "R").alias("filled"))
    return risk.recovery_plan(legs)


SIGNALS = f"""WITH RECURSIVE {TICKS}, g AS (SELECT seq, ts, CAST(key AS VARCHAR) || '-' || kind AS key, value AS profit FROM tick),
 f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS rn FROM g), sent AS (SELECT seq, ts, key, profit, rn FROM f WHERE rn = 1
 UNION ALL SELECT seq, ts, key, profit, rn FROM (SELECT f.*, row_number() OVER (PARTITION BY f.key ORDER BY f.rn) AS pick FROM sent JOIN f ON f.key = sent.key AND f.rn > sent.rn
 AND (epoch_us(f.ts) - epoch_us(sent.ts) > 864000000000 OR f.profit >= sent.profit + 5)) WHERE pick = 1) SELECT seq, key, profit FROM sent"""


@query("signal_dedup_ttl", "T07 K03 A24", SIGNALS)
def signal_dedup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals that are new, older than the lifetime, or 5 points better than the last one sent."""
    signals = ticks(spark, sf_dir).select("seq", "ts", F.concat_ws("-", F.col("key").cast("string"), "kind").alias("key"), F.col("value").alias("profit"))
    return backtest.dedup_signals(signals, ttl_seconds=10 * 86_400.0)


@query("alert_rate_limit", "T08 K11", f"""WITH RECURSIVE {TICKS}, f AS (SELECT seq, ts, kind AS key, row_number() OVER (PARTITION BY kind ORDER BY ts, seq) AS rn FROM tick), sent AS (SELECT seq, ts, key, rn FROM f WHERE rn = 1
 UNION ALL SELECT seq, ts, key, rn FROM (SELECT f.*, row_number() OVER (PARTITION BY f.key ORDER BY f.rn) AS pick FROM sent JOIN f ON f.key = sent.key AND f.rn > sent.rn AND epoch_us(f.ts) - epoch_us(sent.ts) >= 259200000000) WHERE pick = 1)
 SELECT seq, key FROM sent""")
def alert_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of one type are at least the interval apart."""
    alerts = ticks(spark, sf_dir).select("seq", "ts", F.col("kind").alias("key"))
    return backtest.rate_limit(alerts, seconds=3 * 86_400.0)


@query("tick_backtest", "B02 W12 A11", f"""WITH {BOOK}, w AS (SELECT *, greatest(0, least(size, 150 - coalesce(sum(size) OVER (PARTITION BY book_id ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM book WHERE side = 'ask'),
 s AS (SELECT book_id, sum(take) AS filled, sum(take * price) AS cost, min(price) AS best FROM w GROUP BY 1), t AS (SELECT book_id, {q('10 - abs(cost / 150 * 1.005 - best) * 150 - 0.01 * 150')} AS pnl FROM s WHERE filled >= 150 - 1e-9)
 SELECT book_id, pnl, {q('10000 + sum(pnl) OVER (PARTITION BY book_id % 16 ORDER BY book_id ROWS UNBOUNDED PRECEDING)')} AS capital FROM t""")
def tick_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.tick_backtest(book_levels(spark, sf_dir), 150.0, 10.0, 10_000.0, F.col("book_id") % 16)


@query("replay_backtest", "B01 F01", None)
def replay_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays ticks of each key with a strategy that buys dips and sells peaks."""
    t = ticks(spark, sf_dir)
    snaps = t.select(F.col("key").alias("run_id"), "ts", F.lit("t").alias("token_id"), (F.col("value") / (F.col("value") + 50)).alias("best_bid"), (F.col("value") / (F.col("value") + 49)).alias("best_ask"))
    return backtest.replay(snaps, backtest.dip_strategy(0.3, 0.7, 100.0), 1000.0)


@query("odds_backtest", "B03 Y27 A13", f"""WITH h AS (SELECT o_custkey % 50 AS run_id, o_orderkey AS seq, CAST(1.2 AS DOUBLE) + CAST(o_orderkey % 37 AS DOUBLE) / 10 AS odds, o_orderstatus = 'F' AS won FROM orders),
 p AS (SELECT *, 1 / odds + (0.5 - 1 / odds) * 0.3 AS price FROM h), f AS (SELECT *, CASE WHEN 1 / odds - price > 0.05 THEN CASE WHEN won THEN 50 / price - 50 ELSE -50.0 END END AS flow FROM p),
 b AS (SELECT *, 1000 + coalesce(sum(flow) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
 l AS (SELECT *, min(before) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) >= 50 AND flow IS NOT NULL AS live FROM b)
 SELECT run_id, count(*) FILTER (WHERE live) AS bets, count(*) FILTER (WHERE live AND won) AS wins, {q('1000 + coalesce(sum(flow) FILTER (WHERE live), 0)')} AS capital FROM l GROUP BY 1""")
def odds_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bets where skewed prices lie below the probability that the odds imply."""
    orders = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("run_id"), F.col("o_orderkey").alias("seq"), (1.2 + F.col("o_orderkey") % 37 / 10).alias("odds"), F.when(F.col("o_orderstatus") == "F", "H").otherwise("A").alias("result")
    )
    return backtest.odds_backtest(orders, capital=1000.0).withColumn("capital", quantise(F.col("capital")))
