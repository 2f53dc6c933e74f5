"""Domain tables made from the benchmark tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, side, price, size: one level for each price; a part's lines are its orders."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("book_id"), F.when(F.col("l_linestatus") == "O", "ask").otherwise("bid").alias("side"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"),
    )
    return lines.groupBy("book_id", "side", "price").agg(F.sum("size").alias("size"))


BOOK = """book AS (SELECT l_partkey AS book_id, CASE l_linestatus WHEN 'O' THEN 'ask' ELSE 'bid' END AS side,
 l_extendedprice / l_quantity AS price, sum(l_quantity) AS size FROM lineitem GROUP BY 1, 2, 3)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market_id, pos, token_id, price: an order's lines are the outcomes of a market. Lines that are equal in all columns
    of the order are interchangeable."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    lines = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(by))
    return lines.select(
        F.col("l_orderkey").alias("market_id"), "pos", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("pos").cast("string")).alias("token_id"),
        (F.col("l_quantity") / 51).alias("price"), F.col("l_suppkey").alias("event_id"),
    )


OUTCOMES = """outcome AS (SELECT l_orderkey AS market_id, pos, concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(pos AS VARCHAR)) AS token_id,
 l_quantity / 51 AS price, l_suppkey AS event_id FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
 l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS INTEGER) AS pos FROM lineitem))"""


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market_id, volume, liquidity, category, ts: orders with their customers."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("market_id"), F.col("o_totalprice").alias("volume"), F.col("c_acctbal").alias("liquidity"),
        F.col("c_mktsegment").alias("category"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"),
    )


MARKETS = """market AS (SELECT o_orderkey AS market_id, o_totalprice AS volume, c_acctbal AS liquidity, c_mktsegment AS category, o_orderdate AS ts,
 o_orderstatus AS status, o_custkey AS owner FROM orders JOIN customer ON o_custkey = c_custkey)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, key, kind, value, props: the event stream."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("key"), F.col("event_type").alias("kind"), "value", "props"
    )


TICKS = "tick AS (SELECT event_id AS seq, ts, user_id AS key, event_type AS kind, value, props FROM events)"


def quantise(x, digits: int = 6):
    """Half-up rounding that both engines do alike."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def q(x: str, digits: int = 6) -> str:
    """quantise() as SQL."""
    return f"(floor(({x}) * {10**digits} + 0.5) / {10**digits})"


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores (a small file) is dealt to all cores; others are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
