"""Order books: construction, properties, depth and execution prices by walking the levels.

All operators take level rows (book_id, side, price, size) and work by window sums or grouped aggregates, so that books of
any depth stay distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build_book(orders: DataFrame, min_size: float = 1.0) -> DataFrame:
    """Levels from raw maker orders. Odds are scaled by 1e20, amounts by 1e6; inactive orders and those with less
    than min_size left are dropped; a maker on the other outcome gives an ask at one minus the odds."""
    odds = F.col("percentageOdds").cast("double") / 1e20
    left = (F.col("totalBetSize").cast("double") - F.col("fillAmount").cast("double")) / 1e6
    first = F.col("isMakerBettingOutcomeOne")
    return (
        orders.where(F.col("orderStatus") == "ACTIVE").select("marketHash", F.when(first, "bid").otherwise("ask").alias("side"), F.when(first, odds).otherwise(1 - odds).alias("price"), left.alias("size"))
        .where(F.col("size") >= min_size)
    )


def ladder(levels: DataFrame) -> DataFrame:
    """Bids in descending and asks in ascending order, as arrays of (price, size)."""
    level = F.struct("price", "size")
    return levels.groupBy("book_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == "bid", level)), asc=False).alias("bids"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "ask", level))).alias("asks"),
    )


def metrics(levels: DataFrame) -> DataFrame:
    """Best bid (0 if none), best ask (1 if none), spread (1 if one-sided), mid (0.5 if one-sided)."""
    bid, ask = F.max(F.when(F.col("side") == "bid", F.col("price"))), F.min(F.when(F.col("side") == "ask", F.col("price")))
    best = levels.groupBy("book_id").agg(bid.alias("_b"), ask.alias("_a"))
    both = F.col("_b").isNotNull() & F.col("_a").isNotNull()
    return best.select(
        "book_id", F.coalesce("_b", F.lit(0.0)).alias("best_bid"), F.coalesce("_a", F.lit(1.0)).alias("best_ask"),
        F.when(both, F.col("_a") - F.col("_b")).otherwise(1.0).alias("spread"), F.when(both, (F.col("_a") + F.col("_b")) / 2).otherwise(0.5).alias("mid"),
    )


def by_price(side_desc: str = "bid") -> Window:
    """Best level first: bids from the highest, asks from the lowest price."""
    key = F.when(F.col("side") == side_desc, -F.col("price")).otherwise(F.col("price"))
    return Window.partitionBy("book_id", "side").orderBy(key)


def depth(levels: DataFrame, k: int) -> DataFrame:
    """Size and notional of the k best levels and of all levels of each side."""
    ranked = levels.withColumn("rn", F.row_number().over(by_price()))
    top = F.col("rn") <= k
    return ranked.groupBy("book_id", "side").agg(
        F.sum(F.when(top, F.col("size")).otherwise(0.0)).alias("top_size"), F.sum(F.when(top, F.col("price") * F.col("size")).otherwise(0.0)).alias("top_notional"),
        F.sum("size").alias("total_size"), F.count("*").alias("n_levels"),
    )


def liquid(levels: DataFrame, k: int = 5, min_size: float = 100.0) -> DataFrame:
    """Books whose sides both exist and hold at least min_size in their k best levels."""
    d = depth(levels, k)
    return d.groupBy("book_id").agg((F.bool_and(F.col("top_size") >= min_size) & (F.count("*") == 2)).alias("liquid"))


def gatekeeper(levels: DataFrame, side: str, k: int = 3, min_notional: float = 500.0) -> DataFrame:
    """Whether the k best levels of a side are worth at least min_notional."""
    return depth(levels.where(F.col("side") == side), k).select("book_id", F.col("top_notional").alias("notional"), (F.col("top_notional") >= min_notional).alias("passes"))


def taken(target: Column | float, order: Window) -> Column:
    """What of each level an order of the target size takes, walking in the order of the window."""
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.col("size"), target - before))


def walk(levels: DataFrame, side: str, target: float, penalty: float = 0.005) -> DataFrame:
    """Volume-weighted price of buying from the asks or selling to the bids; null if the book is too short.

    Asks cost (1 + penalty), bids pay (1 - penalty).
    """
    key = F.col("price") if side == "ask" else -F.col("price")
    order = Window.partitionBy("book_id").orderBy(key)
    filled = levels.where(F.col("side") == side).withColumn("take", taken(F.lit(float(target)), order))
    sums = filled.groupBy("book_id").agg(F.sum("take").alias("filled"), F.sum(F.col("take") * F.col("price")).alias("cost"))
    factor = 1 + penalty if side == "ask" else 1 - penalty
    return sums.select("book_id", "filled", F.when(F.col("filled") >= target - 1e-9, F.col("cost") / target * factor).alias("vwap"))


def walk_tolerant(levels: DataFrame, side: str, target: float, least: float = 0.99) -> DataFrame:
    """The older rule: accepts a fill of 99 % and divides by what was filled, without penalty."""
    key = F.col("price") if side == "ask" else -F.col("price")
    filled = levels.where(F.col("side") == side).withColumn("take", taken(F.lit(float(target)), Window.partitionBy("book_id").orderBy(key)))
    sums = filled.groupBy("book_id").agg(F.sum("take").alias("filled"), F.sum(F.col("take") * F.col("price")).alias("cost"))
    return sums.select("book_id", "filled", F.when(F.col("filled") >= least * target, F.col("cost") / F.col("filled")).alias("vwap"))


def partial_fill(levels: DataFrame, side: str, size: float) -> DataFrame:
    """A paper fill that may be partial. vwap divides the cost by the requested size, as the paper engine does;
    vwap_filled divides by what was filled."""
    key = F.col("price") if side == "ask" else -F.col("price")
    filled = levels.where(F.col("side") == side).withColumn("take", taken(F.lit(float(size)), Window.partitionBy("book_id").orderBy(key)))
    sums = filled.groupBy("book_id").agg(F.sum("take").alias("filled"), F.sum(F.col("take") * F.col("price")).alias("cost"))
    full = F.col("filled") >= size - 1e-9
    return sums.select(
        "book_id", "filled", F.when(full, "FILLED").when(F.col("filled") > 0, "PARTIAL").otherwise("REJECTED").alias("status"),
        (F.col("cost") / size).alias("vwap"), (F.col("cost") / F.col("filled")).alias("vwap_filled"),
    )


def pressure(levels: DataFrame, wide: float, vacuum_share: float = 0.2) -> DataFrame:
    """Imbalance of the sides, share of the best levels in the depth, vacuum and wide flags; two-sided books only."""
    ranked = levels.withColumn("rn", F.row_number().over(by_price()))
    of = lambda side, what: F.sum(F.when((F.col("side") == side) & what, F.col("size")).otherwise(0.0))
    always, top = F.lit(True), F.col("rn") == 1
    sums = ranked.groupBy("book_id").agg(
        of("bid", always).alias("bid_depth"), of("ask", always).alias("ask_depth"), (of("bid", top) + of("ask", top)).alias("top"),
        F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("bid"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("ask"),
    ).where("bid_depth > 0 and ask_depth > 0")
    total = F.col("bid_depth") + F.col("ask_depth")
    return sums.select(
        "book_id", ((F.col("bid_depth") - F.col("ask_depth")) / total).alias("imbalance"), (F.col("top") / total).alias("top_share"),
        (F.col("top") / total <= vacuum_share).alias("vacuum"), (F.col("ask") - F.col("bid") >= wide).alias("wide"),
    )


def replay_levels(deltas: DataFrame) -> DataFrame:
    """T03 in batch: the state of each level after all updates: the last size of a (book, side, price), gone if zero."""
    last = deltas.groupBy("book_id", "side", "price").agg(F.max_by("size", "seq").alias("size"))
    return last.where("size > 0")
