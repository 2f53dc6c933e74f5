"""Signals over ordered ticks: window expressions by key, and the quoting rules that use them.

All windows are partitioned by key, so ticks of different keys never meet; a key's ticks are ordered by (ts, seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_key(key: str = "key") -> Window:
    """A key's ticks in order."""
    return Window.partitionBy(key).orderBy("ts", "seq")


def rolling_volatility(x: Column, order: Window, n: int = 12) -> Column:
    """Population deviation of the last n values; 0 for less than two."""
    frame = order.rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) < 2, 0.0).otherwise(F.stddev_pop(x).over(frame))


def momentum(x: Column, order: Window, n: int = 5) -> Column:
    """Relative change from the first to the last of the last n values; 0 for less than two or a first value of 0."""
    frame = order.rowsBetween(1 - n, 0)
    first = F.first(x).over(frame)
    return F.when((F.count(x).over(frame) < 2) | (first == 0), 0.0).otherwise((x - first) / first)


def change(x: Column, order: Window) -> Column:
    """Difference to the value before; 0 for the first."""
    return x - F.coalesce(F.lag(x).over(order), x)


def flow_mean(x: Column, order: Window, n: int = 50) -> Column:
    """Mean of the last n signed flows, within -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.avg(x).over(order.rowsBetween(1 - n, 0))))


def burst_ratio(x: Column, order: Window) -> Column:
    """Growth over the value before, which counts as 0.1 at least; 0 if that was not positive."""
    before = F.lag(x).over(order)
    return F.when(before > 0, F.greatest(F.lit(0.0), (x - before) / F.greatest(before, F.lit(0.1)))).otherwise(0.0)


def seconds_since(ts: Column, happened: Column, order: Window) -> Column:
    """Seconds since the last row before for which happened holds; null if there is none."""
    last = F.last(F.when(happened, ts), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 1e6


def running_drawdown(equity: Column, order: Window) -> Column:
    """Distance below the highest value so far, relative to it; 0 while that is not positive."""
    peak = F.max(equity).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(peak > 0, (peak - equity) / peak).otherwise(0.0)


def streaks(df: DataFrame, bad: Column, key: str = "key") -> DataFrame:
    """Adds streak, the number of bad rows in a row that end here (gaps and islands). A row of no value is not bad."""
    order, bad = by_key(key), F.coalesce(bad, F.lit(False))
    island = F.sum((~bad).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    inner = Window.partitionBy(key, "_island").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_island", island).withColumn("streak", F.sum(bad.cast("int")).over(inner)).drop("_island")


def ewma(df: DataFrame, value: str, alpha: float, key: str = "key") -> DataFrame:
    """Final smoothed value of each key: the first value, then x (1 - alpha) + value alpha."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", F.col(value).alias("v")))), lambda r: r["v"])
    vs = df.groupBy(key).agg(ordered.alias("vs"))
    smoothed = F.aggregate(F.slice("vs", 2, F.greatest(F.size("vs") - 1, F.lit(0))), F.get("vs", F.lit(0)), lambda a, v: a * (1 - alpha) + v * alpha)
    return vs.select(key, smoothed.alias("ewma"))


def fee_prediction(fee: Column, order: Window) -> Column:
    """The fee plus half the average change over the last three, at most an eighth above it."""
    frame = order.rowsBetween(-2, 0)
    n = F.count(fee).over(frame)
    predicted = fee + ((fee - F.first(fee).over(frame)) / n * 0.5).cast("long")
    return F.when(n < 2, fee).otherwise(F.least(predicted, fee + (fee * 0.125).cast("long")))


def regime(volatility: Column, trend: Column, buzz: Column, sentiment: Column, shadow: Column, pressure: Column, vol_limit: float, trend_limit: float, widen: float) -> Column:
    """Struct of tag, widen and lean. Later rules win the tag; widenings take the largest, leanings add up."""
    drift = F.abs(trend) >= trend_limit * 1.5
    stressed = (volatility >= vol_limit * 1.5) | drift
    social, whale = buzz >= 0.7, (F.abs(shadow) >= 0.5) | (pressure >= 0.6)
    part = lambda c, share: F.when(c, widen * share).otherwise(0.0)
    return F.struct(
        F.when(whale, "whale-burst").when(social, "social-buzz").when(stressed, F.when(drift, "drifting").otherwise("volatile")).otherwise("normal").alias("tag"),
        F.greatest(part(stressed, 1.0), part(social, 0.6), part(whale, 0.9)).alias("widen"),
        (F.when(social, sentiment * 0.3).otherwise(0.0) + F.when(whale, shadow * 0.5).otherwise(0.0)).alias("lean"),
    )


def pause_reason(volatility: Column, trend: Column, vol_limit: float, trend_limit: float, vol_factor: float = 2.5, trend_factor: float = 2.0) -> Column:
    """Why quoting pauses, null if it goes on."""
    vol, tr = volatility >= vol_limit * vol_factor, F.abs(trend) >= trend_limit * trend_factor
    return F.when(vol & tr, "volatility_and_trend").when(vol, "volatility").when(tr, "trend")


def quote(mid: Column, best_bid: Column, best_ask: Column, imbalance: Column, volatility: Column, trend: Column, buzz: Column, sentiment: Column, pressure: Column, shadow: Column, regime_widen: Column, lean: Column, position: Column, spread: float = 0.02, inside: float = 0.8, wide: float = 0.05, vol_limit: float = 0.02, inventory_skew: float = 0.5) -> Column:
    """Struct of bid and ask, three digits; null where no valid quote is left."""
    half = F.greatest(F.lit(0.001), F.lit(spread / 2))
    book_spread = best_ask - best_bid
    half = F.when(book_spread >= wide, F.least(half, book_spread * inside / 2)).otherwise(half)
    half = F.when(volatility > vol_limit, half * (1 + F.least(F.lit(3.0), (volatility - vol_limit) / vol_limit) * 0.15)).otherwise(half)
    half = half * (1 + 0.1 * buzz) * (1 + 0.2 * pressure) * (1 + 0.1 * F.abs(shadow)) * (1 + regime_widen)
    lift = sentiment * 0.5 * half * 0.5 + shadow * half * 0.35 + lean * half * 0.5 - imbalance * inventory_skew * half - trend * inside * half - position * 0.0001
    three = lambda x: F.floor(x * 1000 + 0.5) / 1000
    bid, ask = three(mid - half + lift), three(mid + half + lift)
    ok = (bid > 0) & (ask < 1) & (bid < ask)
    return F.struct(F.when(ok, F.least(bid, best_ask - 0.001)).alias("bid"), F.when(ok, F.greatest(ask, best_bid + 0.001)).alias("ask"))


def opportunity_score(spread: Column, imbalance: Column, change_: Column, volatility: Column, vacuum: Column, trend: Column, top_share: Column, sentiment: Column, buzz: Column, pressure: Column, shadow: Column, tag: Column, ml: Column, confidence: Column, spread_cfg: float = 0.02, vol_limit: float = 0.02, trend_limit: float = 0.01) -> Column:
    """Capped weighted sum of signals, blended with a model's score by its confidence."""
    one = lambda x: F.least(F.lit(1.0), x)
    heuristic = (
        0.5 * one(spread / spread_cfg) + 0.25 * F.abs(imbalance) + 0.08 * F.abs(change_) + 0.07 * one(volatility / vol_limit) + 0.07 * vacuum.cast("double") + 0.08 * one(F.abs(trend) / trend_limit)
        + 0.05 * (1 - top_share) + 0.05 * F.abs(sentiment) + 0.05 * buzz + 0.05 * pressure + 0.06 * F.abs(shadow) + 0.05 * (tag != "normal").cast("double")
    )
    three = lambda x: F.floor(x * 1000 + 0.5) / 1000
    weight = F.least(F.lit(0.95), 0.35 * F.greatest(F.lit(0.2), confidence) * F.when(pressure >= 0.55, 1.2).otherwise(0.6))
    return three(F.least(F.lit(1.0), three(heuristic) * (1 - weight) + ml * weight))


def adjustment(fill_rate: Column, slippage: Column, volatility: Column, latency: Column, target: float = 0.6, slip_limit: float = 0.01, vol_limit: float = 0.02, latency_limit: float = 350.0, least: float = 0.5, most: float = 1.8) -> Column:
    """Struct of spread widening and size multiplier from smoothed execution telemetry."""
    good, poor = (fill_rate > target) & (slippage <= slip_limit), fill_rate < target * 0.6
    slow, slips = latency > latency_limit, slippage > slip_limit
    flag = lambda c, x: F.when(c, x).otherwise(0.0)
    widen = (
        -flag(good, F.least(F.lit(0.15), (fill_rate - target) / target * 0.1)) + flag(poor, F.lit(0.08)) + flag(volatility > vol_limit, F.least(F.lit(0.3), (volatility - vol_limit) / vol_limit * 0.05))
        + flag(slow, F.lit(0.05)) + flag(slips, F.lit(0.06))
    )
    size = 1 + flag(good, F.least(F.lit(most - 1), fill_rate * 0.35)) - flag(poor, F.lit(0.1)) - flag(slow, F.lit(0.1)) - flag(slips, F.lit(0.05))
    clamp = lambda x, a, b: F.greatest(F.lit(a), F.least(F.lit(b), x))
    return F.struct(clamp(widen, -0.2, 0.4).alias("widen"), clamp(size, least, most).alias("size"))


def execution_health(win_rate: Column, latency: Column, slippage: Column, streak: Column) -> Column:
    """Struct of status, reason (sorted), spread penalty and size multiplier."""
    halts = F.array_compact(F.array(F.when(latency >= 900, "latency"), F.when(streak >= 4, "loss_streak"), F.when(slippage >= 0.05, "slippage")))
    warns = F.array_compact(F.array(F.when(latency >= 350, "latency"), F.when(slippage >= 0.02, "slippage"), F.when(win_rate < 0.45, "win_rate")))
    halt, warn = F.size(halts) > 0, F.size(warns) > 0
    pick = lambda a, b, c: F.when(halt, a).when(warn, b).otherwise(c)
    return F.struct(
        pick("halt", "degraded", "healthy").alias("status"), pick(F.array_join(halts, ","), F.array_join(warns, ","), "").alias("reason"),
        pick(0.35, 0.12, 0.0).alias("penalty"), pick(0.0, 0.7, 1.0).alias("size"),
    )
