"""Replay of history.

Where profit does not depend on the path, replay is a window sum. Where the state feeds back into sizes or decisions it
runs in one Arrow batch for each run (applyInPandas), or by in_order() over the sorted rows of many keys; a single key is then one
task, as its order is inherent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ladderflow.operators.book import walk
from ladderflow.plans.proxies import quantise


def tick_backtest(levels: DataFrame, size: float, expected: float, capital: float, run: Column) -> DataFrame:
    """A signal for each book: expected profit less slippage against the best price and a cost of 1 % of the size;
    books too short for the size are skipped. Capital is the running sum of each run."""
    price = walk(levels, "ask", size).where(F.col("vwap").isNotNull())
    best = levels.where("side = 'ask'").groupBy("book_id").agg(F.min("price").alias("best"))
    pnl = quantise(expected - F.abs(F.col("vwap") - F.col("best")) * size - 0.01 * size)
    rows = price.join(best, "book_id").select("book_id", pnl.alias("pnl"))
    total = F.sum("pnl").over(Window.partitionBy(run).orderBy("book_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("capital", quantise(capital + total))


TRADES = "run_id long, ts timestamp_ntz, token_id string, side string, price double, size double, pnl double, capital double"


def replay(snapshots: DataFrame, strategy: Callable[[pd.Series, dict], dict | None], capital: float, drop_last_batch: bool = True, cap_share: float = 0.1) -> DataFrame:
    """Snapshots (run_id, ts, token_id, best_bid, best_ask) in order of time through a strategy.

    The strategy gets a snapshot and the positions, and gives {side, size} or None. A buy fills at the ask and costs at
    most cap_share of the capital; a sell fills at the bid and is limited by the position. pnl is the cash flow. As the
    original engine never handles the last batch of equal times, drop_last_batch is the default.
    """

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "token_id"], kind="stable")
        if drop_last_batch and len(rows):
            rows = rows[rows["ts"] != rows["ts"].iloc[-1]]
        cash, held, out = capital, {}, []
        for snap in rows.itertuples(index=False):
            signal = strategy(snap, held)
            if not signal:
                continue
            have = held.get(snap.token_id, 0.0)
            if signal["side"] == "BUY" and snap.best_ask > 0:
                size = min(signal["size"], cash * cap_share / snap.best_ask)
                if size <= 0:
                    continue
                flow, price = -size * snap.best_ask, snap.best_ask
                held[snap.token_id] = have + size
            elif signal["side"] == "SELL" and have > 0:
                size = min(signal["size"], have)
                flow, price = size * snap.best_bid, snap.best_bid
                held[snap.token_id] = have - size
            else:
                continue
            cash += flow
            out.append((key[0], snap.ts, snap.token_id, signal["side"], price, size, flow, cash))
        return pd.DataFrame(out, columns=[c.split()[0] for c in TRADES.split(", ")])

    return snapshots.groupBy("run_id").applyInPandas(run, TRADES)


def dip_strategy(low: float, high: float, size: float) -> Callable:
    """A strategy that buys below one price and sells above another."""

    def strategy(snap, held: dict) -> dict | None:
        if snap.best_ask < low:
            return {"side": "BUY", "size": size}
        if snap.best_bid > high and held.get(snap.token_id, 0.0) > 0:
            return {"side": "SELL", "size": size}
        return None

    return strategy


def odds_backtest(history: DataFrame, capital: float, stake: float = 50.0, edge: float = 0.05, inefficiency: float = 0.3) -> DataFrame:
    """History (run_id, seq, odds, result); bets the stake where the skewed price is below the implied probability by
    the edge, wins stake / price on 'H', and stops when the capital is below the stake.

    The stake is constant, so the flows do not depend on the path up to the stop: the capital is a running sum, and rows
    count while it has never been below the stake.
    """
    order = Window.partitionBy("run_id").orderBy("seq")
    true = 1 / F.col("odds")
    price = true + (0.5 - true) * inefficiency
    won = F.col("result") == "H"
    flow = F.when(true - price > edge, F.when(won, stake / price - stake).otherwise(-stake))
    rows = history.withColumn("flow", flow).withColumn("won", won)
    before = capital + F.coalesce(F.sum("flow").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("before", before).withColumn("least", F.min("before").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    live = (F.col("least") >= stake) & F.col("flow").isNotNull()
    return rows.groupBy("run_id").agg(
        F.count_if(live).alias("bets"), F.count_if(live & F.col("won")).alias("wins"), (capital + F.coalesce(F.sum(F.when(live, F.col("flow"))), F.lit(0.0))).alias("capital")
    )


def in_order(rows: DataFrame, columns: list[str], step: Callable, output: str) -> DataFrame:
    """Rows (seq, ts, key, the columns) of each key in order of (ts, seq) through step(state, (seq, microseconds, key, *columns)), which
    gives the next state and an output row or None; a key begins with None. Keys are dealt to tasks and sorted there, and rows
    stream through in Arrow batches: many short keys cost no call each, and of a long one only the state is held."""
    schema = to_arrow_schema(StructType.fromDDL(output))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None  # equal to no key
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[2] != last:
                    last, state = row[2], None
                state, given = step(state, row)
                if given is not None:
                    out.append(given)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    session = rows.sparkSession
    parts = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))  # stated, as few bytes would be put into one task
    dealt = rows.select("seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "key", *columns).repartition(parts, "key")
    return dealt.sortWithinPartitions("key", F.asc_nulls_last("us"), F.asc_nulls_last("seq")).mapInArrow(run, output)


def dedup_signals(signals: DataFrame, ttl_seconds: float = 3600.0, points: float = 5.0) -> DataFrame:
    """Seq of the signals (seq, ts, key, profit) to send: new ones, ones whose last sending is older than the lifetime,
    and ones better by the points than the last sent. The state changes only on sending."""

    def step(sent, row):
        seq, us, key, profit = row
        if sent is not None:
            late = us is not None and sent[0] is not None and us - sent[0] > ttl_seconds * 1e6
            if not late and (profit is None or sent[1] is None or not profit >= sent[1] + points):
                return sent, None
        return (us, profit), (seq, key, profit)

    return in_order(signals, ["profit"], step, "seq long, key string, profit double")


def rate_limit(alerts: DataFrame, seconds: float) -> DataFrame:
    """Seq of the alerts (seq, ts, key) that are at least so many seconds after the last one sent of their type."""

    def step(sent, row):
        seq, us, key = row
        if sent is not None and (us is None or sent[0] is None or us - sent[0] < seconds * 1e6):
            return sent, None
        return (us,), (seq, key)

    return in_order(alerts, [], step, "seq long, key string")


def api_breaker(calls: DataFrame, failures: int = 3, timeout: float = 60.0) -> DataFrame:
    """Whether each call (seq, ts, key, ok) may run: a breaker opens after failures in a row, lets a call through
    once the timeout is over, and closes on success. Calls that may not run do not change the state."""

    def step(state, row):
        bad, opened, last = state or (0, False, None)
        seq, us, key, ok = row
        allowed = not opened or (us is not None and last is not None and us - last > timeout * 1e6)
        if allowed and ok:
            bad, opened = 0, False
        elif allowed:
            bad, last = bad + 1, us
            opened = opened or bad >= failures
        return (bad, opened, last), (seq, key, allowed, "OPEN" if opened else "CLOSED")

    return in_order(calls, ["ok"], step, "seq long, key long, allowed boolean, state string")


def random_walk_maker(spark, seeds: int, steps: int, spread: float, skew: float):
    """A seeded market maker on a random walk for each seed; the same seed gives the same rows."""
    import numpy as np

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(int(key[0]))
        mid, position, cash = 0.5, 0.0, 0.0
        for move in rng.normal(0, 0.01, steps):
            bid, ask = mid - spread / 2 - skew * position, mid + spread / 2 - skew * position
            mid = min(0.99, max(0.01, mid + move))
            if mid <= bid:
                position, cash = position + 1, cash - bid
            elif mid >= ask:
                position, cash = position - 1, cash + ask
        return pd.DataFrame([(int(key[0]), position, cash + position * mid)], columns=["seed", "position", "pnl"])

    return spark.range(seeds).groupBy("id").applyInPandas(run, "seed long, position double, pnl double")
