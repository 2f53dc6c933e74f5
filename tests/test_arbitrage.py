"""Known values of constraint violations, odds and projections."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderflow.functions import odds
from ladderflow.operators import arb, polytope


@pytest.mark.parametrize(("yes", "no", "side", "profit"), [(0.55, 0.5, "SELL", 0.05 / 1.05), (0.45, 0.5, "BUY", 0.05), (0.5, 0.5, None, None)])
def test_binary(spark, yes, no, side, profit):
    rows = arb.binary_violations(spark.createDataFrame([("m", 1, yes), ("m", 2, no), ("x", 1, 0.2), ("x", 2, 0.2), ("x", 3, 0.2)], "market_id string, pos int, price double"), 0.01).collect()
    assert [(r.side, round(r.profit, 6)) for r in rows] == ([] if side is None else [(side, round(profit, 6))])


def test_implication_and_exclusive(spark):
    outcomes = spark.createDataFrame([("m", 1, "plays", 0.4), ("m", 2, "wins", 0.6), ("m", 3, "a", 0.55), ("m", 4, "b", 0.5)], "market_id string, pos int, token_id string, price double")
    rules = spark.createDataFrame([("plays", "wins", "implies", 0.0), ("a", "b", "exclusive", 0.0), ("a", "gone", "exclusive", 0.0)], "outcome_a string, outcome_b string, relation string, expected_diff double")
    pairs = arb.pair_prices(rules, outcomes)
    assert arb.implication_violations(pairs).first().profit == pytest.approx(0.2)
    assert arb.exclusive_violations(pairs).first().profit == pytest.approx(0.05)


def test_odds(spark):
    row = spark.range(1).select(
        odds.decimal_odds(F.lit(0.6)).alias("o"), odds.expected_value(F.lit(0.6), F.lit(1.75)).alias("ev"), odds.kelly_from_edge(F.lit(500.0), F.lit(-1.0), F.lit(0.9)).alias("k0"),
        odds.kelly_from_edge(F.lit(10.0), F.lit(5.0), F.lit(0.9)).alias("k1"), odds.dynamic_ttl(F.lit(1.0)).alias("ttl"), odds.hedged_roi(F.lit(0.0), F.lit(2.0)).alias("none"),
        odds.ev_gate(F.array(F.lit(0.45), F.lit(0.5))).alias("ev2"), odds.epoch_timestamp(F.lit(1735689600000.0)).alias("ms"), odds.epoch_timestamp(F.lit(1735689600.0)).alias("s"),
    ).first()
    assert row.o == 1.667 and row.ev == pytest.approx(0.041) and (row.k0, row.k1) == (0.0, 0.0) and row.ttl == 300 and row.none is None
    assert row.ev2 == pytest.approx(4.463, abs=1e-3) and row.ms == row.s and row.s.year in (2024, 2025)


def test_leg_costs(spark):
    legs = spark.createDataFrame([("s", "BUY", 0.4, 10.0, True), ("s", "SELL", 0.1, 5.0, False), ("t", "BUY", None, 5.0, False)], "strategy_id string, side string, vwap double, size double, on_chain boolean")
    rows = {r.strategy_id: r for r in arb.profit_gate(arb.leg_costs(legs), 5.0, 1.0).collect()}
    assert rows["s"].cost == pytest.approx(3.5) and rows["s"].accepted
    assert rows["t"].cost is None and rows["t"].reason == "insufficient_liquidity" and not rows["t"].accepted


def test_polytope():
    one = polytope.System(2, [({0: 1.0, 1: 1.0}, "=", 1.0)])
    assert one.holds(np.array([[0.5, 0.5], [0.8, 0.8]])).tolist() == [True, False]
    assert one.descent_vertex(np.array([-1.0, 0.0])).tolist() == [1, 0] and one.descent_vertex(np.array([0.0, -1.0])).tolist() == [0, 1]
    assert polytope.barrier_frank_wolfe(np.array([0.2, 0.2]), one, 50) == pytest.approx([0.5, 0.5], abs=0.01)
    order = polytope.System(2, [({0: 1.0, 1: -1.0}, "<=", 0.0)])
    mu = polytope.barrier_frank_wolfe(np.array([0.8, 0.1]), order, 100)
    assert mu[0] <= mu[1] + 0.01
    assert polytope.project_prices(np.array([0.55, 0.55]), [([0, 1], 1.0)], []) == pytest.approx([0.5, 0.5], abs=0.01)
    assert polytope.project_prices(np.array([0.4, 0.6]), [], [(0, 1, 0.0)]) == pytest.approx([0.5, 0.5])
    assert polytope.System(1, [({0: 1.0}, ">=", 2.0)]).status() == "Infeasible"
    assert order.project(np.array([0.9, 0.1])) == pytest.approx([0.5, 0.5])


def test_best_deviation(spark):
    prices = spark.createDataFrame([(1, 0, 0.3), (1, 1, 0.5), (2, 0, 0.5), (2, 1, 0.5)], "group_id long, idx int, price double")
    rows = polytope.best_deviation(polytope.project_groups(prices)).collect()
    assert [(r.group_id, r.side) for r in rows] == [(1, "buy")] and rows[0].edge == pytest.approx(0.1)
