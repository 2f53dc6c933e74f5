"""Queries over order books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderflow.operators import book
from ladderflow.plans.catalog import query
from ladderflow.plans.proxies import BOOK, book_levels, q, quantise, table

WALK = """SELECT *, greatest(0, least(size, {target} - coalesce(sum(size) OVER (PARTITION BY book_id ORDER BY {key}
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM book WHERE side = '{side}'"""


def _walk_sql(side: str, target: float, body: str) -> str:
    key = "price" if side == "ask" else "price DESC"
    return f"WITH {BOOK}, w AS ({WALK.format(target=target, key=key, side=side)}), s AS (SELECT book_id, sum(take) AS filled, sum(take * price) AS cost FROM w GROUP BY 1) {body}"


@query("flagship_mispriced_books", "W01 Y05 P03 L01", _walk_sql("ask", 100, f"""SELECT book_id, p_retailprice AS reference, {q('cost / 100 * 1.005')} AS vwap,
 {q('(cost / 100 * 1.005 / p_retailprice - 1) * 100')} AS edge_pct FROM s JOIN part ON book_id = p_partkey WHERE filled >= 100 - 1e-9
 ORDER BY edge_pct, book_id LIMIT 50"""))
def flagship_mispriced_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of buying 100 units of each book against its reference price; the 50 cheapest."""
    cost = book.walk(book_levels(spark, sf_dir), "ask", 100).where(F.col("vwap").isNotNull())
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book_id"), F.col("p_retailprice").alias("reference"))
    both = cost.join(part, "book_id")
    edge = quantise((F.col("vwap") / F.col("reference") - 1) * 100)
    return both.select("book_id", "reference", quantise(F.col("vwap")).alias("vwap"), edge.alias("edge_pct")).orderBy("edge_pct", "book_id").limit(50)


@query("book_top_of_book", "A08 S13 S16 S37", f"""WITH {BOOK}, b AS (SELECT book_id, max(price) FILTER (WHERE side = 'bid') AS b, min(price) FILTER (WHERE side = 'ask') AS a
 FROM book GROUP BY 1) SELECT book_id, coalesce(b, 0.0) AS best_bid, coalesce(a, 1.0) AS best_ask, CASE WHEN b IS NOT NULL AND a IS NOT NULL THEN a - b ELSE 1.0 END AS spread,
 CASE WHEN b IS NOT NULL AND a IS NOT NULL THEN (a + b) / 2 ELSE 0.5 END AS mid FROM b""")
def book_top_of_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.metrics(book_levels(spark, sf_dir))


@query("book_depth_topk", "A06 S09", f"""WITH {BOOK}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS rn FROM book)
 SELECT book_id, side, sum(CASE WHEN rn <= 3 THEN size ELSE 0.0 END) AS top_size, {q('sum(CASE WHEN rn <= 3 THEN price * size ELSE 0.0 END)')} AS top_notional,
 sum(size) AS total_size, count(*) AS n_levels FROM r GROUP BY 1, 2""")
def book_depth_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.depth(book_levels(spark, sf_dir), 3).withColumn("top_notional", quantise(F.col("top_notional")))


@query("book_ladders", "A07", f"""WITH {BOOK} SELECT book_id, count(*) FILTER (WHERE side = 'bid') AS n_bids, count(*) FILTER (WHERE side = 'ask') AS n_asks,
 max(price) FILTER (WHERE side = 'bid') AS first_bid, min(price) FILTER (WHERE side = 'ask') AS first_ask FROM book GROUP BY 1""")
def book_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = book.ladder(book_levels(spark, sf_dir))
    return rows.select("book_id", F.size("bids").cast("long").alias("n_bids"), F.size("asks").cast("long").alias("n_asks"), F.get("bids", F.lit(0))["price"].alias("first_bid"), F.get("asks", F.lit(0))["price"].alias("first_ask"))


@query("book_from_orders", "A07 S12 S30", """SELECT marketHash, side, price, size FROM (SELECT CAST(l_partkey AS VARCHAR) AS marketHash, CASE WHEN l_linestatus = 'O' THEN 'bid' ELSE 'ask' END AS side,
 floor((CASE WHEN l_linestatus = 'O' THEN l_discount * 5 ELSE 1 - l_discount * 5 END) * 1000000 + 0.5) / 1000000 AS price, l_quantity - floor(l_quantity / 3) AS size
 FROM lineitem WHERE l_returnflag <> 'R') WHERE size >= 1""")
def book_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw maker orders in scaled strings, turned into levels again."""
    line = table(spark, sf_dir, "lineitem")
    raw = line.select(
        F.col("l_partkey").cast("string").alias("marketHash"), F.when(F.col("l_returnflag") == "R", "CANCELLED").otherwise("ACTIVE").alias("orderStatus"),
        (F.col("l_discount") * 5 * 1e20).cast("decimal(38,0)").cast("string").alias("percentageOdds"), (F.col("l_quantity") * 1e6).cast("decimal(38,0)").cast("string").alias("totalBetSize"),
        (F.floor(F.col("l_quantity") / 3) * 1e6).cast("decimal(38,0)").cast("string").alias("fillAmount"), (F.col("l_linestatus") == "O").alias("isMakerBettingOutcomeOne"),
    )
    return book.build_book(raw, 0.0).select("marketHash", "side", quantise(F.col("price")).alias("price"), "size").where("size >= 1")


for _side, _name, _id in (("ask", "buy", "W01"), ("bid", "sell", "W02")):
    _factor = "1.005" if _side == "ask" else "0.995"

    @query(f"book_walk_{_name}_vwap", _id, _walk_sql(_side, 150, f"SELECT book_id, filled, CASE WHEN filled >= 150 - 1e-9 THEN {q(f'cost / 150 * {_factor}')} END AS vwap FROM s"))
    def _walk(spark: SparkSession, sf_dir: str, side: str = _side) -> DataFrame:
        return book.walk(book_levels(spark, sf_dir), side, 150).withColumn("vwap", quantise(F.col("vwap")))


@query("book_walk_legacy", "W03", _walk_sql("ask", 300, f"SELECT book_id, filled, CASE WHEN filled >= 0.99 * 300 THEN {q('cost / filled')} END AS vwap FROM s"))
def book_walk_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.walk_tolerant(book_levels(spark, sf_dir), "ask", 300).withColumn("vwap", quantise(F.col("vwap")))


@query("paper_partial_fill", "W04", _walk_sql("ask", 400, f"""SELECT book_id, filled, CASE WHEN filled >= 400 - 1e-9 THEN 'FILLED' WHEN filled > 0 THEN 'PARTIAL' ELSE 'REJECTED' END AS status,
 {q('cost / 400')} AS vwap, {q('cost / filled')} AS vwap_filled FROM s"""))
def paper_partial_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = book.partial_fill(book_levels(spark, sf_dir), "ask", 400)
    return rows.withColumn("vwap", quantise(F.col("vwap"))).withColumn("vwap_filled", quantise(F.col("vwap_filled")))


_RANKED = f"{BOOK}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS rn FROM book)"


@query("book_liquidity_top5", "P17", f"""WITH {_RANKED}, d AS (SELECT book_id, side, sum(CASE WHEN rn <= 5 THEN size ELSE 0 END) AS t FROM r GROUP BY 1, 2)
 SELECT book_id, bool_and(t >= 120) AND count(*) = 2 AS liquid FROM d GROUP BY 1""")
def book_liquidity_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.liquid(book_levels(spark, sf_dir), 5, 120.0)


@query("book_notional_gate", "P18", f"""WITH {_RANKED}, d AS (SELECT book_id, sum(CASE WHEN rn <= 3 THEN price * size ELSE 0 END) AS t FROM r WHERE side = 'ask' GROUP BY 1)
 SELECT book_id, {q('t')} AS notional, t >= 120000 AS passes FROM d""")
def book_notional_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.gatekeeper(book_levels(spark, sf_dir), "ask", 3, 120000.0).withColumn("notional", quantise(F.col("notional")))


@query("book_metrics", "Y23", f"""WITH {_RANKED}, s AS (SELECT book_id, sum(CASE WHEN side = 'bid' THEN size ELSE 0 END) AS bd, sum(CASE WHEN side = 'ask' THEN size ELSE 0 END) AS ad,
 sum(CASE WHEN rn = 1 THEN size ELSE 0 END) AS top, max(price) FILTER (WHERE side = 'bid') AS b, min(price) FILTER (WHERE side = 'ask') AS a FROM r GROUP BY 1)
 SELECT book_id, {q('(bd - ad) / (bd + ad)')} AS imbalance, {q('top / (bd + ad)')} AS top_share, top / (bd + ad) <= 0.2 AS vacuum, a - b >= 0.5 AS wide FROM s WHERE bd > 0 AND ad > 0""")
def book_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = book.pressure(book_levels(spark, sf_dir), 0.5)
    return rows.withColumn("imbalance", quantise(F.col("imbalance"))).withColumn("top_share", quantise(F.col("top_share")))


@query("l2_book_replay", "T03", """WITH d AS (SELECT l_partkey AS book_id, l_linestatus AS side, l_discount AS price, CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_quantity END AS size,
 l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem), l AS (SELECT *, row_number() OVER (PARTITION BY book_id, side, price
 ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC, size DESC) AS rn FROM d) SELECT book_id, side, price, size FROM l WHERE rn = 1 AND size > 0""")
def l2_book_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level updates in order; a size of zero deletes the level."""
    size = F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity"))
    line = table(spark, sf_dir, "lineitem").withColumn("size", size)
    seq = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "size").alias("seq")
    return book.replay_levels(line.select(F.col("l_partkey").alias("book_id"), F.col("l_linestatus").alias("side"), F.col("l_discount").alias("price"), "size", seq))
