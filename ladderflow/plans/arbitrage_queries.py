"""Queries over outcome prices: constraint violations, returns, stakes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderflow.functions import odds
from ladderflow.operators import arb
from ladderflow.plans.catalog import query
from ladderflow.plans.proxies import OUTCOMES, outcomes, q, quantise, table


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[quantise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


_EVENTS = "ev AS (SELECT l_orderkey AS event_id, l_partkey AS market_id, min(l_discount) AS price FROM lineitem GROUP BY 1, 2)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is an event; its parts are markets priced by the discount, zero meaning that no price is known."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("market_id"))
    return line.agg(F.min("l_discount").alias("price"))


@query("sum_to_one_events", "A02", f"""WITH {_EVENTS}, s AS (SELECT event_id, sum(price * 8) AS total, count(*) AS n, array_to_string(list_sort(list(DISTINCT market_id)), ',') AS tokens
 FROM ev WHERE price > 0 GROUP BY 1) SELECT event_id, {q('total')} AS total, n, tokens, {q('1 - total')} AS edge, CASE WHEN 1 - total > 0 THEN 'BUY' ELSE 'SELL' END AS side
 FROM s WHERE n >= 2 AND abs(1 - total) > 0.0051""")
def sum_to_one_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _events(spark, sf_dir).withColumn("price", F.when(F.col("price") > 0, F.col("price") * 8))
    rows = arb.sum_to_one(prices, 0.0051).withColumn("tokens", F.array_join(F.transform("tokens", lambda x: x.cast("string")), ","))
    return _round(rows, "total", "edge")


@query("negrisk_events", "A03", f"""WITH {_EVENTS}, s AS (SELECT event_id, count(*) AS n, count(*) FILTER (WHERE price > 0) AS n_priced, sum(1 - price) FILTER (WHERE price > 0) AS total FROM ev GROUP BY 1)
 SELECT event_id, n, n_priced, {q('total')} AS total, {q('n - 1 - total')} AS edge FROM s WHERE n > 2 AND n_priced >= 3 AND n - 1 - total > 0.0051""")
def negrisk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _events(spark, sf_dir).withColumn("price", F.when(F.col("price") > 0, F.col("price")))
    return _round(arb.neg_risk(prices, 0.0051), "total", "edge")


_BINARY = f"""WITH {OUTCOMES}, s AS (SELECT market_id, count(*) AS n, sum(price) AS total, arg_min(price, pos) AS yes, arg_max(price, pos) AS no FROM outcome GROUP BY 1),
 v AS (SELECT *, CASE WHEN total > 1 THEN (total - 1) / total ELSE 1 - total END AS profit FROM s WHERE n = 2 AND abs(total - 1) > 0.005)"""


@query("binary_sum_violations", "A04", f"""{_BINARY} SELECT market_id, yes, no, CASE WHEN total > 1 THEN 'sum_exceeds_one' ELSE 'sum_below_one' END AS violation,
 CASE WHEN total > 1 THEN 'SELL' ELSE 'BUY' END AS side, {q('profit')} AS profit, {q('least(1.0, profit / 0.05)')} AS confidence FROM v""")
def binary_sum_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(arb.binary_violations(outcomes(spark, sf_dir)), "profit", "confidence")


_PAIRS = f"""{OUTCOMES}, o AS (SELECT token_id, market_id, pos, price FROM outcome),
 p AS (SELECT a.token_id AS outcome_a, b.token_id AS outcome_b, CASE WHEN a.market_id % 2 = 0 THEN 'implies' ELSE 'exclusive' END AS relation, 0.1 AS expected_diff, a.price AS price_a, b.price AS price_b
 FROM o a JOIN o b ON a.market_id = b.market_id AND b.pos = a.pos + 1)"""


def _constraint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring outcomes of a market are bound: by implication in even markets, exclusively in odd ones."""
    rows = outcomes(spark, sf_dir)
    following = F.concat_ws("-", F.col("market_id").cast("string"), (F.col("pos") + 1).cast("string"))
    relation = F.when(F.col("market_id") % 2 == 0, "implies").otherwise("exclusive")
    constraints = rows.select(F.col("token_id").alias("outcome_a"), following.alias("outcome_b"), relation.alias("relation"), F.lit(0.1).alias("expected_diff"))
    return arb.pair_prices(constraints, rows)


@query("implication_violations", "J17 S05", f"WITH {_PAIRS} SELECT outcome_a, outcome_b, {q('price_b + expected_diff - price_a')} AS profit FROM p WHERE relation = 'implies' AND price_b + expected_diff - price_a > 0.005")
def implication_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(arb.implication_violations(_constraint_pairs(spark, sf_dir)).select("outcome_a", "outcome_b", "profit"), "profit")


@query("exclusive_violations", "J17", f"WITH {_PAIRS} SELECT outcome_a, outcome_b, {q('price_a + price_b - 1')} AS profit FROM p WHERE relation = 'exclusive' AND price_a + price_b - 1 > 0.005")
def exclusive_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(arb.exclusive_violations(_constraint_pairs(spark, sf_dir)).select("outcome_a", "outcome_b", "profit"), "profit")


@query("all_opportunities", "L05 U01", f"""{_BINARY}, o AS (SELECT token_id, market_id, pos, price FROM outcome), p AS (SELECT a.token_id AS key, a.market_id % 2 AS odd, a.price AS pa, b.price AS pb FROM o a
 JOIN o b ON a.market_id = b.market_id AND b.pos = a.pos + 1), u AS (SELECT 'binary' AS kind, CAST(market_id AS VARCHAR) AS key, {q('profit')} AS profit FROM v
 UNION ALL SELECT 'implies', key, {q('pb + 0.1 - pa')} FROM p WHERE odd = 0 AND pb + 0.1 - pa > 0.005 UNION ALL SELECT 'exclusive', key, {q('pa + pb - 1')} FROM p WHERE odd = 1 AND pa + pb - 1 > 0.005)
 SELECT kind, key, profit FROM u""")
def all_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _constraint_pairs(spark, sf_dir)
    part = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), quantise(F.col("profit")).alias("profit"))
    rows = part(arb.binary_violations(outcomes(spark, sf_dir)), "binary", "market_id")
    rows = rows.unionByName(part(arb.implication_violations(pairs), "implies", "outcome_a")).unionByName(part(arb.exclusive_violations(pairs), "exclusive", "outcome_a"))
    return arb.best_first(rows)


_LINE = "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, {cols} FROM (SELECT *, l_quantity / 51 AS p, 1 + l_extendedprice / 20000 AS o, l_discount AS d, l_tax AS t FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line: price p, odds o, and two small shares d and t."""
    line = table(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", (F.col("l_quantity") / 51).alias("p"), (1 + F.col("l_extendedprice") / 20000).alias("o"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))


def _over_lines(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return lines.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", *[(c if n.startswith("is_") else quantise(c)).alias(n) for n, c in columns.items()])


def _columns():
    """p, o, d and t as columns; made when a session is there."""
    return F.col("p"), F.col("o"), F.col("d"), F.col("t")


@query("odds_conversions", "Y02 Y03 Y04", _LINE.format(cols=f"""{q('CASE WHEN p - 0.02 <= 0 THEN 1000.0 WHEN p - 0.02 >= 1 THEN 1.01 ELSE floor(1 / (p - 0.02) * 1000 + 0.5) / 1000 END')} AS decimal_odds,
 {q('CASE WHEN o <= 0 THEN 0.0 ELSE 1 / o END')} AS implied, {q('1 + (o - 1) * 0.98')} AS after_commission, {q('p * (1 + (o - 1) * 0.98) - 1')} AS ev"""))
def odds_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    P, O, D, T = _columns()
    return _over_lines(spark, sf_dir, decimal_odds=odds.decimal_odds(P - 0.02), implied=odds.implied_probability(O), after_commission=odds.after_commission(O), ev=odds.expected_value(P, O))


@query("roi_back_lay", "Y05 Y07", _LINE.format(cols=f"{q('CASE WHEN p > 0 AND p < 1 AND o > 1 THEN (1 / (p + 1 / (1 + (o - 1) * 0.98)) - 1) * 100 END')} AS roi, {q('(p - 1 / o) * 100 - 0.05 - 2.0')} AS ev_net"))
def roi_back_lay(spark: SparkSession, sf_dir: str) -> DataFrame:
    P, O, D, T = _columns()
    return _over_lines(spark, sf_dir, roi=odds.hedged_roi(P, O), ev_net=odds.ev_net(P, O))


@query("roi_lay_hedge", "Y06", _LINE.format(cols=f"{q('CASE WHEN p > 0 AND o > 1 THEN (1 / (p + (o - 1) / (o - 0.02)) - 1) * 100 END')} AS roi"))
def roi_lay_hedge(spark: SparkSession, sf_dir: str) -> DataFrame:
    P, O, D, T = _columns()
    return _over_lines(spark, sf_dir, roi=odds.lay_hedge_roi(P, O))


@query("roi_odds_ratio", "Y09", _LINE.format(cols=f"{q('(1 / p - o) / o * 100')} AS forward, {q('(o - 1 / p) / (1 / p) * 100')} AS backward"))
def roi_odds_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    P, O, D, T = _columns()
    return _over_lines(spark, sf_dir, forward=odds.odds_ratio_roi(1 / P, O), backward=odds.odds_ratio_roi(O, 1 / P))


@query("two_direction_arb", "Y08", _LINE.format(cols=f"""CASE WHEN p + 1 / (1 + (o - 1) * 0.98) < 1 AND d * 500 >= 10 THEN 'BUY_A_SELL_B' WHEN (1 - p) + d * 5 < 1 AND t * 500 >= 10 THEN 'BUY_NO_A' ELSE 'NONE' END AS is_direction,
 {q('CASE WHEN p + 1 / (1 + (o - 1) * 0.98) < 1 AND d * 500 >= 10 THEN (1 / (p + 1 / (1 + (o - 1) * 0.98)) - 1) * 100 WHEN (1 - p) + d * 5 < 1 AND t * 500 >= 10 THEN (1 / ((1 - p) + d * 5) - 1) * 100 ELSE 0.0 END')} AS roi"""))
def two_direction_arb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buy on the first venue and sell on the second if that costs less than 1, else buy NO there; volumes of at least 10."""
    P, O, D, T = _columns()
    first, second = P + 1 / odds.after_commission(O), (1 - P) + D * 5
    a, b = (first < 1) & (D * 500 >= 10), (second < 1) & (T * 500 >= 10)
    return _over_lines(spark, sf_dir, is_direction=F.when(a, "BUY_A_SELL_B").when(b, "BUY_NO_A").otherwise("NONE"), roi=F.when(a, (1 / first - 1) * 100).when(b, (1 / second - 1) * 100).otherwise(0.0))


@query("fee_strip", "Y10", _LINE.format(cols="CAST(CAST(floor(d * 100 + 0.5) AS DECIMAL(20,8)) - 7 AS DOUBLE) AS net, CAST(abs(CAST(floor(d * 100 + 0.5) AS DECIMAL(20,8)) - 7) AS DOUBLE) AS net_abs"))
def fee_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    P, O, D, T = _columns()
    net, absolute = odds.strip_fees(F.floor(D * 100 + 0.5))
    return _over_lines(spark, sf_dir, net=net.cast("double"), net_abs=absolute.cast("double"))


@query("merge_split_profit", "Y11", _LINE.format(cols=f"""{q('(1 - (p + d) - greatest(1 - (p + d), 0) * 0.02) / (p + d) * 100')} AS merge_pct, {q('(p + t - 0.5 - greatest(p + t - 0.5, 0) * 0.02) / 0.5 * 100')} AS split_pct"""))
def merge_split_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    P, O, D, T = _columns()
    return _over_lines(spark, sf_dir, merge_pct=odds.merge_split_profit(P + D, F.lit(1.0)), split_pct=odds.merge_split_profit(F.lit(0.5), P + T))


@query("kelly_sizes", "Y13", _LINE.format(cols=f"""{q('least(CASE WHEN o - 1 > 0 THEN greatest(0.0, ((o - 1) * p - (1 - p)) / (o - 1)) ELSE 0.0 END * 0.25, 0.05) * 1000')} AS fractional,
 {q('CASE WHEN d * 100 <= 0 THEN 0.0 WHEN least(greatest(0.0, (d * p - (1 - p)) / d) * 500, 25) < 5 THEN 0.0 ELSE least(greatest(0.0, (d * p - (1 - p)) / d) * 500, 25) END')} AS from_edge"""))
def kelly_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    P, O, D, T = _columns()
    return _over_lines(spark, sf_dir, fractional=odds.kelly_size(F.lit(1000.0), P, O - 1), from_edge=odds.kelly_from_edge(F.lit(500.0), D * 100, P))


@query("fx_convert", "Y14", """SELECT o_orderkey, source, target, floor(o_totalprice / r1 * r2 * 100 + 0.5) / 100 AS amount FROM (SELECT o_orderkey, o_totalprice, CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS source,
 CASE o_custkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS target, CASE o_orderkey % 3 WHEN 0 THEN CAST(1.0 AS DOUBLE) WHEN 1 THEN CAST(0.92 AS DOUBLE) ELSE CAST(0.78 AS DOUBLE) END AS r1,
 CASE o_custkey % 3 WHEN 0 THEN CAST(1.0 AS DOUBLE) WHEN 1 THEN CAST(0.92 AS DOUBLE) ELSE CAST(0.78 AS DOUBLE) END AS r2 FROM orders)""")
def fx_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = lambda c: F.when(F.col(c) % 3 == 0, "USD").when(F.col(c) % 3 == 1, "EUR").otherwise("GBP")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", code("o_orderkey").alias("source"), code("o_custkey").alias("target"), "o_totalprice")
    return rows.select("o_orderkey", "source", "target", odds.convert(F.col("o_totalprice"), F.col("source"), F.col("target")).alias("amount"))


@query("cost_and_ttl", "Y15 Y16 Y17 Y21 Y22 Y27 W13", _LINE.format(cols=f"""{q('(o * 10 + 30) * 1e9 * 200000 / 1e18 * 0.5')} AS gas_usd, {q('t * 100 - p * 100 * 2 * 0.01 - t * 100 * 0.04')} AS paper_pnl, {q('abs(p - d) / p * 100')} AS slippage,
 CASE WHEN l_linenumber % 2 = 0 THEN d > t ELSE d < t END AS is_worse, {q('floor(3600 - 3300 * d)')} AS ttl, {q('abs(o - 1.5) / 1.5')} AS drift, {q('p + (0.5 - p) * 0.3')} AS skewed"""))
def cost_and_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    P, O, D, T = _columns()
    side = F.when(F.col("l_linenumber") % 2 == 0, "BUY").otherwise("SELL")
    return _over_lines(
        spark, sf_dir, gas_usd=odds.gas_usd(O * 10, F.lit(200000), F.lit(0.5)), paper_pnl=odds.paper_pnl(T * 100, P * 100), slippage=odds.slippage_pct(D, P),
        is_worse=odds.is_worse(side, D, T), ttl=odds.dynamic_ttl(D).cast("double"), drift=odds.drift(O, F.lit(1.5)), skewed=odds.skewed_price(P, 0.3),
    )


@query("vector_divergence", "Y18 Y19", f"""WITH {OUTCOMES}, m AS (SELECT market_id, list(price ORDER BY pos) AS mu FROM outcome WHERE price < 1 GROUP BY 1)
 SELECT market_id, {q("list_sum(list_transform(mu, lambda x: x * ln(x / 0.5)))")} AS kl, {q("-list_sum(list_transform(mu, lambda x: ln(x) + ln(1 - x)))")} AS barrier,
 {q("1 / (1 + exp(-(list_sum(mu) - 2)))")} AS logistic FROM m""")
def vector_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outcomes(spark, sf_dir).where("price < 1").groupBy("market_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "price"))), lambda x: x["price"]).alias("mu"))
    total = F.aggregate("mu", F.lit(0.0), lambda s, x: s + x)
    half = F.transform("mu", lambda x: F.lit(0.5))
    return rows.select("market_id", quantise(odds.kl_divergence(F.col("mu"), half)).alias("kl"), quantise(odds.log_barrier(F.col("mu"))).alias("barrier"), quantise(odds.sigmoid(total - 2)).alias("logistic"))


@query("ev_gate", "P25 F06", f"""WITH {OUTCOMES}, s AS (SELECT market_id, sum(price) AS cost FROM outcome GROUP BY 1) SELECT market_id, {q('(1 - cost) / cost * 100 - 0.5 - 0.3')} AS ev, (1 - cost) / cost * 100 - 0.8 >= 0.5 AS passes FROM s""")
def ev_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outcomes(spark, sf_dir).groupBy("market_id").agg(F.collect_list("price").alias("prices"))
    ev = odds.ev_gate(F.col("prices"))
    return rows.select("market_id", quantise(ev).alias("ev"), (ev >= 0.5).alias("passes"))


@query("leg_cost_gate", "A09 A23 P24", f"""WITH s AS (SELECT l_orderkey AS strategy_id, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END * l_discount * l_quantity) AS cost,
 sum(CASE WHEN l_returnflag = 'A' THEN 0.05 ELSE 0.0 END) AS fees, count(*) FILTER (WHERE l_discount = 0) AS short FROM lineitem GROUP BY 1)
 SELECT strategy_id, CASE WHEN short = 0 THEN {q('cost')} END AS cost, {q('fees')} AS fees, CASE WHEN short > 0 THEN 'insufficient_liquidity' END AS reason,
 coalesce(short = 0 AND 5 - cost - fees >= 1.00001, false) AS accepted FROM s""")
def leg_cost_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    legs = line.select(
        F.col("l_orderkey").alias("strategy_id"), F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("vwap"),
        F.col("l_quantity").alias("size"), (F.col("l_returnflag") == "A").alias("on_chain"),
    )
    return _round(arb.profit_gate(arb.leg_costs(legs), 5.0, 1.00001).select("strategy_id", "cost", "fees", "reason", "accepted"), "cost", "fees")


@query("best_strategy_per_market", "L06 Y12", f"""WITH r AS (SELECT l_orderkey AS market_id, l_linestatus AS strategy, max((l_discount - l_tax - 0.02) / 0.5 * 100) AS roi FROM lineitem GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY roi DESC, strategy) AS rn FROM r WHERE roi >= 3) SELECT market_id, strategy, {q('roi')} AS roi FROM k WHERE rn = 1""")
def best_strategy_per_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better of two strategies, if it returns at least 3 %."""
    roi = F.max((F.col("l_discount") - F.col("l_tax") - 0.02) / 0.5 * 100)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("market_id"), F.col("l_linestatus").alias("strategy")).agg(roi.alias("roi")).where("roi >= 3")
    return _round(arb.top_per_group(rows, "market_id", [F.desc("roi"), "strategy"]), "roi")
