"""Violations of price constraints: sums over outcomes, implications, exclusive outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sum_to_one(prices: DataFrame, threshold: float = 0.005) -> DataFrame:
    """Events (event_id, market_id, price of YES) with at least two priced markets whose prices do not add up to 1."""
    sums = prices.where("price is not null").groupBy("event_id").agg(F.sum("price").alias("total"), F.count("*").alias("n"), F.sort_array(F.collect_set("market_id")).alias("tokens"))
    edge = 1 - F.col("total")
    return sums.where("n >= 2").withColumn("edge", edge).where(F.abs("edge") > threshold).withColumn("side", F.when(F.col("edge") > 0, "BUY").otherwise("SELL"))


def neg_risk(prices: DataFrame, threshold: float = 0.005) -> DataFrame:
    """(N - 1) less the sum of NO prices, N counting all markets of the event; at least 3 priced of more than 2."""
    sums = prices.groupBy("event_id").agg(F.count("*").alias("n"), F.count("price").alias("n_priced"), F.sum(1 - F.col("price")).alias("total"))
    return sums.where("n > 2 and n_priced >= 3").withColumn("edge", F.col("n") - 1 - F.col("total")).where(F.col("edge") > threshold)


def binary_violations(prices: DataFrame, threshold: float = 0.005) -> DataFrame:
    """Markets of exactly two outcomes (market_id, pos, price) whose prices add up to more or less than 1.

    Selling both gains (sum - 1) / sum, buying both gains 1 - sum; confidence is the gain over 5 %, at most 1.
    """
    sums = prices.groupBy("market_id").agg(F.count("*").alias("n"), F.sum("price").alias("total"), F.min_by("price", "pos").alias("yes"), F.max_by("price", "pos").alias("no"))
    over = F.col("total") > 1
    profit = F.when(over, (F.col("total") - 1) / F.col("total")).otherwise(1 - F.col("total"))
    found = sums.where("n = 2").where(F.abs(F.col("total") - 1) > threshold).withColumn("profit", profit)
    return found.select(
        "market_id", "yes", "no", F.when(over, "sum_exceeds_one").otherwise("sum_below_one").alias("violation"), F.when(over, "SELL").otherwise("BUY").alias("side"),
        "profit", F.least(F.lit(1.0), F.col("profit") / 0.05).alias("confidence"),
    )


def pair_prices(constraints: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Constraints (outcome_a, outcome_b, ...) with both prices; a missing outcome drops the constraint, of a repeated
    token the first position counts."""
    first = outcomes.groupBy("token_id").agg(F.min_by("price", F.struct("market_id", "pos")).alias("price"))
    a = first.select(F.col("token_id").alias("outcome_a"), F.col("price").alias("price_a"))
    b = first.select(F.col("token_id").alias("outcome_b"), F.col("price").alias("price_b"))
    return constraints.join(a, "outcome_a").join(b, "outcome_b")


def implication_violations(pairs: DataFrame, threshold: float = 0.005) -> DataFrame:
    """If a follows from b, a may not cost less than b plus the expected difference."""
    profit = F.col("price_b") + F.col("expected_diff") - F.col("price_a")
    return pairs.where("relation = 'implies'").withColumn("profit", profit).where(F.col("profit") > threshold)


def exclusive_violations(pairs: DataFrame, threshold: float = 0.005) -> DataFrame:
    """Two outcomes that exclude each other may not cost more than 1 together."""
    profit = F.col("price_a") + F.col("price_b") - 1
    return pairs.where("relation = 'exclusive'").withColumn("profit", profit).where(F.col("profit") > threshold)


def leg_costs(legs: DataFrame, gas_per_leg: float = 0.05) -> DataFrame:
    """Signed cost of a strategy's legs (strategy_id, side, vwap, size, on_chain) plus gas for each on-chain leg;
    a leg without depth (null vwap) gives the reason instead of a cost."""
    signed = F.when(F.col("side") == "BUY", 1).otherwise(-1) * F.col("vwap") * F.col("size")
    sums = legs.groupBy("strategy_id").agg(F.sum(signed).alias("cost"), F.sum(F.when(F.col("on_chain"), gas_per_leg).otherwise(0.0)).alias("fees"), F.count_if(F.col("vwap").isNull()).alias("short"))
    return sums.select("strategy_id", F.when(F.col("short") == 0, F.col("cost")).alias("cost"), "fees", F.when(F.col("short") > 0, "insufficient_liquidity").alias("reason"))


def profit_gate(costs: DataFrame, payout: float, min_profit: float) -> DataFrame:
    """Strategies whose payout exceeds cost and fees by the least profit."""
    return costs.withColumn("profit", payout - F.col("cost") - F.col("fees")).withColumn("accepted", F.coalesce(F.col("profit") >= min_profit, F.lit(False)))


def best_first(opportunities: DataFrame) -> DataFrame:
    """Opportunities by edge, largest first."""
    return opportunities.orderBy(F.desc("profit"), "kind", "key")


def top_per_group(df: DataFrame, group: str, order: list, k: int = 1) -> DataFrame:
    """The first k rows of each group; the order must be total."""
    by = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(by)).where(F.col("_rn") <= k).drop("_rn")
