"""Risk limits as window expressions: the batch twins of the keyed state machines.

Latched states (a breaker that stays open) are running maxima; counts that reset each day are windows by day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(*by: str) -> Window:
    """All rows so far of a partition, in order."""
    return Window.partitionBy(*by).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)


def validated_balance(raw: Column) -> Column:
    """A balance as a number; whatever is no finite number counts as 0 (fail closed)."""
    x = raw.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def breaker_by_day(df: DataFrame, failed: Column, warmup: int = 10, limit: float = 0.2) -> DataFrame:
    """Error rate so far of each day, and whether the breaker has tripped: rate above the limit after the warm-up,
    latched until the day ends. The breaker is one for all keys, so a day is a hot group: counts run within minutes, and
    what came before a minute is added from the day's (at most 1,440) minutes."""
    rows = df.withColumn("day", F.to_date("ts")).withColumn("_minute", F.date_trunc("minute", "ts")).withColumn("_bad", failed.cast("int"))
    w, earlier = running("day", "_minute"), Window.partitionBy("day").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    before = rows.groupBy("day", "_minute").agg(F.count("*").alias("n"), F.sum("_bad").alias("bad")).select("day", "_minute", total("n").alias("_n0"), total("bad").alias("_bad0"))
    rated = rows.join(before, ["day", "_minute"]).withColumn("attempts", F.col("_n0") + F.count("*").over(w)).withColumn("rate", (F.col("_bad0") + F.sum("_bad").over(w)) / F.col("attempts"))
    rated = rated.withColumn("_now", ((F.col("attempts") >= warmup) & (F.col("rate") > limit)).cast("int"))
    return _latched(rated, "tripped").drop("_now", "_minute", "_bad", "_n0", "_bad0")


def _latched(rows: DataFrame, name: str) -> DataFrame:
    """Whether _now was 1 in this or an earlier row of the day; rows carry day and _minute."""
    w, earlier = running("day", "_minute"), Window.partitionBy("day").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("day", "_minute").agg(F.max("_now").alias("m")).select("day", "_minute", F.coalesce(F.max("m").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(before, ["day", "_minute"]).withColumn(name, F.greatest(F.col("_before"), F.max("_now").over(w)) == 1).drop("_before")


def capital_breaker(df: DataFrame, balance: Column, max_drawdown: float = 0.05, least: float = 10.0) -> DataFrame:
    """Trips on a balance below the least, or on a loss since the day's first balance above the limit; latched. Minutes
    bound the windows, as in breaker_by_day()."""
    rows = df.withColumn("day", F.to_date("ts")).withColumn("_minute", F.date_trunc("minute", "ts")).withColumn("balance", balance)
    first = rows.groupBy("day").agg(F.min_by("balance", F.struct("ts", "seq")).alias("_start"))
    start, rows = F.col("_start"), rows.join(first, "day")
    now = (F.col("balance") < least) | ((start > 0) & ((start - F.col("balance")) / start > max_drawdown))
    return _latched(rows.withColumn("_now", now.cast("int")), "broken").drop("_now", "_minute", "_start")


def burst(df: DataFrame, happened: Column, seconds: int = 60, limit: int = 10, key: str = "key") -> DataFrame:
    """Events of the last seconds by event time, and whether they reach the limit."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("recent", F.sum(happened.cast("int")).over(w)).withColumn("blocked", F.col("recent") >= limit)


def guardian(df: DataFrame, pnl: Column, initial: float, max_drawdown: float = 0.1, losers: int = 5, pause_minutes: int = 60, key: str = "key") -> DataFrame:
    """Balance, losing streak, and until when trading pauses: an hour from the last row that broke a limit on."""
    from ladderflow.operators.signals import streaks

    w = running(key)
    rows = streaks(df.withColumn("pnl", pnl), F.col("pnl") < 0, key).withColumn("balance", initial + F.sum("pnl").over(w))
    down = F.greatest(initial - F.col("balance"), F.lit(0.0)) / initial
    breaks = (down > max_drawdown) | (F.col("streak") >= losers)
    until = F.max(F.when(breaks, F.col("ts") + F.expr(f"INTERVAL {pause_minutes} MINUTES"))).over(w)
    return rows.withColumn("drawdown", down).withColumn("pause_until", until)


def daily_limits(df: DataFrame, notional: Column, pnl: Column, max_size: float, max_daily: float, loss_limit: float, key: str = "key") -> DataFrame:
    """Notional and loss so far of each key and day (before this order), and the first limit that it breaks."""
    w = Window.partitionBy(key, "day").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("day", F.to_date("ts")).withColumn("notional", notional).withColumn("pnl", pnl)
    rows = rows.withColumn("used", F.coalesce(F.sum(F.abs("notional")).over(w), F.lit(0.0)))
    rows = rows.withColumn("lost", F.coalesce(F.sum(F.greatest(-F.col("pnl"), F.lit(0.0))).over(w), F.lit(0.0)))
    reason = F.when(F.abs("notional") > max_size, "size").when(F.col("lost") >= loss_limit, "daily_loss_limit").when(F.col("used") + F.abs("notional") > max_daily, "daily_notional")
    return rows.withColumn("reason", reason)


def staleness(df: DataFrame, now: Column, limit_seconds: float = 5.0) -> DataFrame:
    """By feed, seconds since the last tick and whether it is healthy."""
    last = df.groupBy("key").agg(F.max("ts").alias("last"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1e6
    return last.withColumn("age", age).withColumn("healthy", age <= limit_seconds)


def operational(volatility: Column, base: Column, error_rate: Column, latency: Column) -> Column:
    """Why the operational breaker trips (sorted, comma-joined), null if it does not."""
    reasons = F.array_compact(F.array(F.when(error_rate >= 0.05, "error_rate"), F.when(latency >= 250, "latency"), F.when((base > 0) & (volatility >= base * 2), "volatility")))
    return F.when(F.size(reasons) > 0, F.array_join(reasons, ","))


def leg_outcome(primary: Column, hedge: Column, size: Column, loss: float = 0.02) -> Column:
    """Struct of state and profit of two legs: both, none, or one of them, which loses a share of the size."""
    state = F.when(primary & hedge, "BOTH").when(~primary & ~hedge, "NONE").when(primary, "LEGGED_PRIMARY").otherwise("LEGGED_HEDGE")
    return F.struct(state.alias("state"), F.when(primary != hedge, -size * loss).otherwise(0.0).alias("pnl"))


def recovery_plan(legs: DataFrame) -> DataFrame:
    """Failed legs are retried at the extreme price of their side, else filled legs are closed on the other side."""
    other = F.when(F.col("side") == "BUY", "SELL").otherwise("BUY")
    failed = ~F.col("filled")
    return legs.select(
        "strategy_id", "leg", F.when(failed, "RETRY").otherwise("LIQUIDATE").alias("action"), F.when(failed, F.col("side")).otherwise(other).alias("order_side"),
        F.when(failed, F.when(F.col("side") == "BUY", 1.0).otherwise(0.0)).alias("limit_price"),
    )


def chase_prices(side: Column, price: Column, breakeven: Column, step_pct: float = 0.5, tries: int = 3) -> Column:
    """Limit prices that chase a partial fill towards the break-even price, at most so many, none worse than it. For a
    lay a higher price is worse, else a lower one; the price moves up by the step unless break-even is worse than it."""
    worse = lambda new, than: F.when(side == "LAY", new > than).otherwise(new < than)

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"] * (1 + step_pct / 100 * F.when(worse(breakeven, acc["at"]), -1).otherwise(1))
        stop = acc["stop"] | worse(at, breakeven)
        return F.struct(at.alias("at"), stop.alias("stop"), F.when(stop, acc["tried"]).otherwise(F.concat(acc["tried"], F.array(at))).alias("tried"))

    begin = F.struct(price.cast("double").alias("at"), F.lit(False).alias("stop"), F.array().cast("array<double>").alias("tried"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(tries)), begin, step, lambda acc: acc["tried"])
