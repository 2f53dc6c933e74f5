"""Known values of books and signals."""

import pytest
from pyspark.sql import functions as F

from ladderflow.operators import book, signals


def levels(spark, rows):
    return spark.createDataFrame(rows, "book_id string, side string, price double, size double")


@pytest.mark.parametrize(
    ("side", "rows", "target", "expected"),
    [
        ("ask", [(0.5, 100.0), (0.6, 100.0)], 150, 80 / 150 * 1.005), ("ask", [(0.5, 100.0)], 150, None), ("bid", [(0.5, 100.0), (0.4, 100.0)], 150, 70 / 150 * 0.995),
        ("ask", [(0.6, 100.0), (0.5, 100.0)], 100, 0.5 * 1.005), ("ask", [(0.5, 100.0)], 100, 0.5 * 1.005),
    ],
)
def test_walk(spark, side, rows, target, expected):
    got = book.walk(levels(spark, [("b", side, p, s) for p, s in rows]), side, target).first()["vwap"]
    assert got == (None if expected is None else pytest.approx(expected))


def test_metrics_of_one_sided_books(spark):
    rows = {r.book_id: r for r in book.metrics(levels(spark, [("a", "bid", 0.4, 1.0), ("a", "ask", 0.6, 1.0), ("b", "bid", 0.4, 1.0), ("c", "ask", 0.7, 1.0)])).collect()}
    assert rows["a"].mid == pytest.approx(0.5) and rows["a"].spread == pytest.approx(0.2)
    assert (rows["b"].best_ask, rows["b"].mid, rows["b"].spread) == (1.0, 0.5, 1.0) and rows["c"].best_bid == 0.0


def test_vacuum(spark):
    rows = [("a", "bid", 0.49, 1.0), ("a", "bid", 0.48, 9.0), ("a", "ask", 0.51, 1.0), ("a", "ask", 0.52, 9.0)]
    r = book.pressure(levels(spark, rows), 0.5).first()
    assert r.top_share == pytest.approx(0.1) and r.vacuum


def test_book_from_orders(spark):
    orders = spark.createDataFrame(
        [("h", "ACTIVE", str(45 * 10**18), "10000000", "1000000", True), ("h", "ACTIVE", str(60 * 10**18), "5000000", "0", False), ("h", "FILLED", str(10**19), "9000000", "0", True), ("h", "ACTIVE", str(10**19), "900000", "0", True)],
        "marketHash string, orderStatus string, percentageOdds string, totalBetSize string, fillAmount string, isMakerBettingOutcomeOne boolean",
    )
    rows = sorted((r.side, round(r.price, 9), r.size) for r in book.build_book(orders).collect())
    assert rows == [("ask", 0.4, 5.0), ("bid", 0.45, 9.0)]


def test_quote_rules(spark):
    lit = F.lit
    zero = [lit(0.0)] * 5
    make = lambda mid, bid, ask: signals.quote(lit(mid), lit(bid), lit(ask), lit(0.0), lit(0.0), *zero, lit(0.0), lit(0.0), lit(0))
    row = spark.range(1).select(make(0.5, 0.49, 0.51).alias("a"), make(0.005, 0.004, 0.006).alias("b"), make(0.5, 0.4, 0.6).alias("c")).first()
    assert (row.a.bid, row.a.ask) == (0.49, 0.51)
    assert row.b.bid is None and row.b.ask is None
    assert (row.c.bid, row.c.ask) == (0.49, 0.51)


def test_execution_health(spark):
    h = lambda *x: signals.execution_health(*map(F.lit, x))
    row = spark.range(1).select(h(1.0, 425.0, 0.04, 2).alias("a"), h(1.0, 100.0, 0.06, 0).alias("b"), h(1.0, 100.0, 0.0, 0).alias("c")).first()
    assert (row.a.status, row.a.size, row.b.status, row.b.size, row.c.status) == ("degraded", 0.7, "halt", 0.0, "healthy")
