"""End-to-end queries: scan, link, price, gate, aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderflow.functions import odds
from ladderflow.operators import book, link
from ladderflow.plans.catalog import query
from ladderflow.plans.link_queries import _BAND, _events
from ladderflow.plans.proxies import BOOK, book_levels, q, quantise, table


_CYCLE = f"""{_BAND}, k AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY gap, right_id) AS rn FROM j), p AS (SELECT left_id, right_id, CAST(left_id % 90 AS DOUBLE) / 100 + 0.05 AS price, 1.2 + CAST(right_id % 50 AS DOUBLE) / 10 AS lay FROM k WHERE rn = 1),
 z AS (SELECT *, (1 / (price + (lay - 1) / (lay - 0.02)) - 1) * 100 AS roi FROM p)"""


def _cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link.nearest_match(*_events(spark, sf_dir))
    rows = found.select("left_id", "right_id", (F.col("left_id") % 90 / 100 + 0.05).alias("price"), (1.2 + F.col("right_id") % 50 / 10).alias("lay"))
    return rows.withColumn("roi", odds.lay_hedge_roi(F.col("price"), F.col("lay")))


@query("shadow_cycle", "P32 Y06 J04 K15", f"WITH {_CYCLE} SELECT left_id, right_id, {q('roi')} AS roi FROM z WHERE roi > 0 AND lay > 1.01")
def shadow_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, link, price, and keep what returns more than nothing."""
    return _cycle(spark, sf_dir).where("roi > 0 and lay > 1.01").select("left_id", "right_id", quantise(F.col("roi")).alias("roi"))


@query("audit_summary", "A01 P32 J13", f"""WITH {_CYCLE}, a AS (SELECT l.region, count(*) AS fetched, count(z.left_id) AS matched, count(*) FILTER (WHERE roi > 0) AS profitable, {q('coalesce(max(roi), 0)')} AS best FROM l LEFT JOIN z ON l.id = z.left_id GROUP BY 1) SELECT region, fetched, matched, profitable, best FROM a""")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By region: scanned, linked, profitable, best return."""
    left, _ = _events(spark, sf_dir)
    priced = _cycle(spark, sf_dir).select(F.col("left_id").alias("id"), "roi")
    return left.join(priced, "id", "left").groupBy("region").agg(
        F.count("*").alias("fetched"), F.count("roi").alias("matched"), F.count_if(F.col("roi") > 0).alias("profitable"), quantise(F.coalesce(F.max("roi"), F.lit(0.0))).alias("best")
    )


@query("snapshot_recorder", "K02", f"""WITH {BOOK}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS rn FROM book),
 s AS (SELECT book_id, max(price) FILTER (WHERE side = 'bid') AS b, min(price) FILTER (WHERE side = 'ask') AS a, sum(size) FILTER (WHERE side = 'bid' AND rn <= 5) AS bd, sum(size) FILTER (WHERE side = 'ask' AND rn <= 5) AS ad FROM r GROUP BY 1)
 SELECT book_id, {q('(a + b) / 2')} AS mid_price, {q('a - b')} AS spread, bd AS bid_depth, ad AS ask_depth FROM s WHERE a IS NOT NULL AND b IS NOT NULL""")
def snapshot_recorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mid, spread and depth of five levels of two-sided books, as a recorder stores them."""
    levels = book_levels(spark, sf_dir)
    best = book.metrics(levels)
    d = book.depth(levels, 5).groupBy("book_id").agg(F.max(F.when(F.col("side") == "bid", F.col("top_size"))).alias("bid_depth"), F.max(F.when(F.col("side") == "ask", F.col("top_size"))).alias("ask_depth"))
    both = d.where("bid_depth is not null and ask_depth is not null").join(best, "book_id")
    return both.select("book_id", quantise(F.col("mid")).alias("mid_price"), quantise(F.col("best_ask") - F.col("best_bid")).alias("spread"), "bid_depth", "ask_depth")


@query("opportunity_log", "K15", """SELECT o_orderkey, floor(o_totalprice * 100 + 0.5) / 100 AS value, CASE WHEN o_orderstatus = 'F' THEN 'DATA_LOGGED' ELSE 'PENDING' END AS label FROM orders""")
def opportunity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", quantise(F.col("o_totalprice"), 2).alias("value"), F.when(F.col("o_orderstatus") == "F", "DATA_LOGGED").otherwise("PENDING").alias("label"))
