"""Keyed state machines with a deadline, as stateful operators of a stream.

A machine is plain: how a row changes the state of its key (``step``), when the key must be looked at again if no row comes
(``due``), and what happens then (``expire``). One stateful processor runs them all: it keeps the state of a key in the state
store, takes rows in order of event time, and sets an event-time timer to the deadline. A deadline that a later row of the
key passes is met before that row, so results do not depend on how the stream is cut into batches; the timer serves keys
that fall silent.

Time is event time in microseconds (the original uses the clock of the process). Rows that are not behind the last one of
their key, in (time, seq), change nothing; so do rows without time. Rows older than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE = 60_000_000
DAY = 1_440 * MINUTE


class Machine:
    """State is a dict of the fields of ``state`` (DDL, in order); rows and outputs are dicts."""

    state: str
    initial: dict
    columns: str  # further input columns
    output: str  # further output columns
    strict = False  # whether a row exactly at the deadline still comes before it

    def step(self, s: dict, row: dict) -> Iterator[dict]:
        raise NotImplementedError

    def due(self, s: dict) -> int | None:
        raise NotImplementedError

    def expire(self, s: dict, at: int) -> Iterator[dict]:
        raise NotImplementedError


def names(ddl: str) -> list[str]:
    """Column names of a flat DDL."""
    return [c.split()[0] for c in ddl.split(",")]


def run_rows(machine: Machine, s: dict, rows: list[dict], last: tuple | None) -> tuple[list[dict], tuple | None]:
    """The outputs of rows of one key in order, and the place of the last row; s is changed."""
    out: list[dict] = []
    for r in sorted(rows, key=lambda r: (r["us"], r["seq"])):
        place = (r["us"], r["seq"])
        if last is not None and place <= last:
            continue
        last, at = place, machine.due(s)
        if at is not None and (r["us"] > at if machine.strict else r["us"] >= at):
            out += ({"seq": None, "us": at, **o} for o in machine.expire(s, at))
        out += ({"seq": r["seq"], "us": r["us"], **o} for o in machine.step(s, r))
    return out, last


class Keyed(StatefulProcessor):
    """Runs a machine for each key."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.fields = names(machine.state)
        self.columns = ["key", "seq", "us", *names(machine.output)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("machine", f"{self.machine.state}, last_us long, last_seq long")

    def _load(self) -> tuple[dict, tuple | None]:
        if not self.kept.exists():
            return dict(self.machine.initial), None
        *values, us, seq = self.kept.get()
        plain = [None if v is None or v != v else v for v in values]  # NaN stands for null
        return dict(zip(self.fields, plain, strict=True)), None if us is None else (int(us), int(seq))

    def _store(self, s: dict, last: tuple | None) -> None:
        self.kept.update((*(s[f] for f in self.fields), *(last or (None, None))))
        at = self.machine.due(s)
        wanted = None if at is None else -(-at // 1000)  # timers are in milliseconds
        for t in list(self.handle.listTimers()):
            if t != wanted:
                self.handle.deleteTimer(t)
        if wanted is not None:
            self.handle.registerTimer(wanted)

    def _frame(self, key, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([{"key": key[0], **r} for r in rows], columns=self.columns, dtype=object)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        s, last = self._load()
        new = pd.concat(list(rows)).to_dict("records")
        new = [{k: None if v is pd.NaT or v != v else v for k, v in r.items()} for r in new]
        out, last = run_rows(self.machine, s, [{**r, "us": int(r["us"]), "seq": int(r["seq"])} for r in new], last)
        self._store(s, last)
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        s, last = self._load()
        at = self.machine.due(s)
        if at is not None and -(-at // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            out = [{"seq": None, "us": at, **o} for o in self.machine.expire(s, at)]
            self._store(s, last)
            if out:
                yield self._frame(key, out)

    def close(self) -> None:
        pass


def run_machine(ticks: DataFrame, machine: Machine, key_type: str = "long", delay: str = "10 minutes") -> DataFrame:
    """A stream (key, seq, ts, the machine's columns) through a machine: key, seq (null for deadlines), ts, the machine's
    output. delay bounds how late rows may come, and how long after a deadline its row appears."""
    timed = ticks.where("ts IS NOT NULL AND seq IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = timed.select("key", F.col("seq").cast("long").alias("seq"), "ts", F.unix_micros("ts").alias("us"), *names(machine.columns))
    out = rows.groupBy("key").transformWithStateInPandas(Keyed(machine), f"key {key_type}, seq long, us long, {machine.output}", "append", "eventTime")
    return out.select("key", "seq", F.timestamp_micros("us").alias("ts"), *names(machine.output))


class Guardian(Machine):
    """Balance and losing streak of a key; a loss beyond the drawdown or a long streak pauses trading for a while from
    that row on, and the pause is lifted by time alone. event: trade, or lifted at the end of a pause."""

    state = "total double, streak long, until long, paused boolean"
    columns = "pnl double"
    output = "event string, streak long, drawdown double, pause_until long"

    def __init__(self, initial: float, max_drawdown: float = 0.05, losers: int = 5, pause_minutes: float = 60):
        self.start, self.most, self.losers, self.pause = initial, max_drawdown, losers, int(pause_minutes * MINUTE)
        self.initial = {"total": 0.0, "streak": 0, "until": None, "paused": False}

    def step(self, s, row):
        pnl = row["pnl"] or 0.0
        s["total"] += pnl  # apart from the start, as the batch twin adds up: a loss that equals the limit rounds alike
        s["streak"] = s["streak"] + 1 if pnl < 0 else 0
        down = max(self.start - (self.start + s["total"]), 0.0) / self.start if self.start > 0 else 0.0
        if down > self.most or s["streak"] >= self.losers:
            s["until"], s["paused"] = row["us"] + self.pause, True
        yield {"event": "trade", "streak": s["streak"], "drawdown": down, "pause_until": s["until"]}

    def due(self, s):
        return int(s["until"]) if s["paused"] else None

    def expire(self, s, at):
        s["paused"] = False
        yield {"event": "lifted", "streak": None, "drawdown": None, "pause_until": at}


class Operational(Machine):
    """Trips on volatility, error rate or latency and stays so for the cooldown; what happens meanwhile changes nothing.
    event: checked, or reset at the end of a cooldown."""

    state = "until long, reason string"
    columns = "volatility double, base double, error_rate double, latency double"
    output = "event string, tripped boolean, reason string"
    strict = True

    def __init__(self, cooldown_seconds: float = 300, multiple: float = 2.0, most_errors: float = 0.05, most_latency: float = 250.0):
        self.cooldown, self.multiple, self.errors, self.latency = int(cooldown_seconds * 1e6), multiple, most_errors, most_latency
        self.initial = {"until": None, "reason": None}

    def step(self, s, row):
        if s["until"] is None:
            v, base, errors, latency = (row[c] or 0.0 for c in names(self.columns))
            reasons = [n for n, bad in (("error_rate", errors >= self.errors), ("latency", latency >= self.latency), ("volatility", base > 0 and v >= base * self.multiple)) if bad]
            if reasons:
                s["until"], s["reason"] = row["us"] + self.cooldown, ",".join(reasons)
        yield {"event": "checked", "tripped": s["until"] is not None, "reason": s["reason"]}

    def due(self, s):
        return None if s["until"] is None else int(s["until"])

    def expire(self, s, at):
        s["until"] = s["reason"] = None
        yield {"event": "reset", "tripped": False, "reason": None}


class Capital(Machine):
    """The day's breaker of a key: an unsafe balance, a loss since the day's first balance, or too many failed
    orders after a warm-up; open until the day (UTC) ends. Counts and balance start anew each day. A balance that is no
    finite number counts as 0. event: checked, or rollover when the day of an open breaker ends."""

    state = "day long, start double, attempts long, failed long, reason string"
    columns = "balance string, ok boolean"
    output = "event string, balance double, attempts long, broken boolean, reason string"

    def __init__(self, max_drawdown: float = 0.05, most_errors: float = 0.2, warmup: int = 10, least: float = 10.0):
        self.most, self.errors, self.warmup, self.least = max_drawdown, most_errors, warmup, least
        self.initial = {"day": None, "start": None, "attempts": 0, "failed": 0, "reason": None}

    def step(self, s, row):
        day = row["us"] // DAY
        if s["day"] != day:
            s.update(self.initial, day=day)
        try:
            balance = float(row["balance"])
        except (TypeError, ValueError):
            balance = 0.0
        if balance != balance or abs(balance) == float("inf"):
            balance = 0.0
        s["start"] = balance if s["start"] is None else s["start"]
        s["attempts"] += 1
        s["failed"] += not row["ok"]
        if balance < self.least:
            s["reason"] = s["reason"] or "balance"
        elif s["start"] > 0 and (s["start"] - balance) / s["start"] > self.most:
            s["reason"] = s["reason"] or "drawdown"
        if s["attempts"] >= self.warmup and s["failed"] / s["attempts"] > self.errors:
            s["reason"] = s["reason"] or "errors"
        yield {"event": "checked", "balance": balance, "attempts": s["attempts"], "broken": s["reason"] is not None, "reason": s["reason"]}

    def due(self, s):
        return None if s["reason"] is None else (int(s["day"]) + 1) * DAY

    def expire(self, s, at):
        yield {"event": "rollover", "balance": None, "attempts": s["attempts"], "broken": False, "reason": s["reason"]}
        s.update(self.initial)


class Cache(Machine):
    """Entries with a lifetime: ``put`` stores or replaces the key's entry, ``get`` finds it while it lives. An entry
    that outlives its time is dropped from the state by a timer, so the state holds living entries only. event: stored, hit,
    miss, or expired. A row's ttl (seconds) goes before the cache's own; inclusive: an entry lives at its last instant too.

    (State with a TTLConfig ages by the clock of the machine, so its hits could not be told from the events; timers can.)"""

    state = "data string, stamp long, ttl long"
    columns = "op string, data string, ttl double"
    output = "event string, data string"

    def __init__(self, ttl_seconds: float, inclusive: bool = False):
        self.ttl, self.strict = int(ttl_seconds * 1e6), inclusive
        self.initial = {"data": None, "stamp": None, "ttl": None}

    def step(self, s, row):
        if row["op"] == "put":
            s.update(data=row["data"], stamp=row["us"], ttl=int(row["ttl"] * 1e6) if row["ttl"] is not None else self.ttl)
            yield {"event": "stored", "data": row["data"]}
        else:
            yield {"event": "hit" if s["stamp"] is not None else "miss", "data": s["data"]}

    def due(self, s):
        return None if s["stamp"] is None else int(s["stamp"]) + int(s["ttl"])

    def expire(self, s, at):
        data = s["data"]
        s.update(self.initial)
        yield {"event": "expired", "data": data}


def book_stream(updates: DataFrame, tops: bool = False, bid: str = "BUY") -> DataFrame:
    """A stream of updates (book_id, seq array, kind, side, price, size) as a stream of changed levels, for last_levels() or, with
    tops, which marks the bid side, for last_tops(). A row of kind snapshot clears what is older than itself and sets its level; one
    of kind delta sets a level or, with a size of 0 or less, deletes it.

    seq is an array of numbers, compared from left to right. The state of a level is its last change by seq, also of a deleted one,
    and that of a book its last snapshot, a row without side and price. Both are maxima, so rows that come out of order change nothing
    that is newer, the end does not depend on how rows were dealt to batches, and the state needs no Python. What a snapshot cleared
    is told by its seq. Rows without side, price, size or seq are left out.
    """
    whole = updates.where("side IS NOT NULL AND price IS NOT NULL AND size IS NOT NULL AND seq IS NOT NULL")
    price, size = F.col("price").cast("double"), F.greatest(F.col("size").cast("double"), F.lit(0.0))
    level = F.struct(F.col("side").alias("side"), price.alias("price"), size.alias("size"))
    gone = F.struct(F.lit(None).cast("string").alias("side"), F.lit(None).cast("double").alias("price"), F.lit(0.0).alias("size"))
    places = F.when(F.col("kind") == "snapshot", F.array(level, gone)).otherwise(F.array(level))
    rows = whole.select("book_id", F.col("seq").cast("array<double>").alias("seq"), "kind", F.explode(places).alias("x"))
    last = F.max(F.struct("seq", "kind", F.col("x.size").alias("size")))
    out = rows.groupBy("book_id", F.col("x.side").alias("side"), F.col("x.price").alias("price")).agg(last.alias("last"))
    out = out.select("book_id", "side", "price", "last.size", "last.seq")
    return out.withColumn("is_bid", F.col("side") == bid) if tops else out


def _levels(changes: DataFrame) -> DataFrame:
    """The last change of each level, and whether it is live: it has a size and no later snapshot cleared it."""
    own = changes.repartition("book_id").groupBy(*[c for c in changes.columns if c not in ("size", "seq")]).agg(F.max(F.struct("seq", "size")).alias("x"))
    cleared = F.max(F.when(F.col("side").isNull(), F.col("x.seq"))).over(Window.partitionBy("book_id"))
    live = F.col("side").isNotNull() & (F.col("x.size") > 0) & (F.col("cleared").isNull() | (F.col("x.seq") >= F.col("cleared")))
    return own.withColumn("cleared", cleared).withColumn("live", live).withColumn("size", F.col("x.size")).drop("x", "cleared")


def last_levels(changes: DataFrame) -> DataFrame:
    """The book that a table of changed levels leads to."""
    return _levels(changes).where("live").select("book_id", "side", "price", "size")


def last_tops(changes: DataFrame) -> DataFrame:
    """The last best prices of each book, of one without levels too."""
    by = Window.partitionBy("book_id")
    bid, ask = F.col("live") & F.col("is_bid"), F.col("live") & ~F.col("is_bid")
    rows = _levels(changes).withColumn("best_bid", F.max(F.when(bid, F.col("price"))).over(by)).withColumn("best_ask", F.min(F.when(ask, F.col("price"))).over(by))
    size = lambda side, best: F.coalesce(F.sum(F.when(side & (F.col("price") == F.col(best)), F.col("size"))), F.lit(0.0))
    tops = rows.groupBy("book_id").agg(
        F.max("best_bid").alias("best_bid"), size(bid, "best_bid").alias("bid_size"), F.max("best_ask").alias("best_ask"), size(ask, "best_ask").alias("ask_size"), F.count_if("live").alias("levels"),
    )
    mid, spread = (F.col("best_bid") + F.col("best_ask")) / 2, F.col("best_ask") - F.col("best_bid")
    return tops.select("book_id", "best_bid", "bid_size", "best_ask", "ask_size", mid.alias("mid"), spread.alias("spread"), "levels")
