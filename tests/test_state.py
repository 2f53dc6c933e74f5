"""Keyed state of streams: books, machines with deadlines, committed batches; each against a plain version, however the rows are
dealt to batches."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ladderflow.streaming import machines
from ladderflow.streaming.committed import Manifests, read_committed, run_committed
from ladderflow.streaming.ticks import read_ticks, run_available

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
US0 = int(T0.timestamp() * 1e6)
BOOK = "book_id long, seq array<double>, kind string, side string, price double, size double"


def feed(spark, folder, rows, schema):
    """One more file of a stream's folder; returns the stream, one file a batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return read_ticks(spark, str(folder), spark.createDataFrame([], schema).schema, 1)


def plain_book(rows):
    """The book after all updates in order."""
    levels = {}
    for book, seq, kind, side, price, size in sorted(rows, key=lambda r: r[1]):
        if kind == "snapshot":
            levels = {k: v for k, v in levels.items() if k[0] != book or v[1] >= seq}
        levels[book, side, price] = (size, seq)
    return {k: v[0] for k, v in levels.items() if v[0] > 0}


def test_book_over_restarts_and_out_of_order(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(3)), [float(i // 2), float(i % 2)], "snapshot" if rng.random() < 0.04 else "delta", "BUY" if rng.random() < 0.5 else "SELL", float(rng.integers(1, 6)), float(max(0, rng.integers(-2, 4)))) for i in range(240)]
    odd = [(1, None, "delta", "BUY", 1.0, 1.0), (1, [9e9], "delta", None, 1.0, 1.0), (1, [9e9], "delta", "BUY", None, 1.0), (1, [9e9], "delta", "BUY", 1.0, None)]
    mixed = [rows[i] for i in rng.permutation(240)]
    for begin in range(0, 240, 60):  # four runs on one checkpoint, each with more files; some rows come twice
        for part in (mixed[begin : begin + 30] + odd, mixed[begin + 20 : begin + 60]):
            stream = feed(spark, tmp_path / "in", part, BOOK)
        levels = run_committed(machines.book_stream(stream), str(tmp_path / "levels"), "update")
        tops = run_committed(machines.book_stream(stream, tops=True), str(tmp_path / "tops"), "update")
        seen = plain_book(mixed[: begin + 60])
        assert {(r.book_id, r.side, r.price): r["size"] for r in machines.last_levels(levels).collect()} == seen
        for r in machines.last_tops(tops).collect():
            own = {k[1:]: v for k, v in seen.items() if k[0] == r.book_id}
            bid, ask = max((p for s, p in own if s == "BUY"), default=None), min((p for s, p in own if s == "SELL"), default=None)
            assert (r.best_bid, r.best_ask, r.levels) == (bid, ask, len(own)) and r.bid_size == own.get(("BUY", bid), 0) and r.ask_size == own.get(("SELL", ask), 0)
            assert (r.mid is None) == (bid is None or ask is None)
    assert levels.count() > len(seen)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def run_plain(machine, rows, key, watermark):
    """One key in plain Python: all rows in order, then the deadline if time has passed it."""
    s = dict(machine.initial)
    out, _ = machines.run_rows(machine, s, [{**r, "us": US0 + int(r.pop("m") * machines.MINUTE)} for r in map(dict, rows)], None)
    due = machine.due(s)
    if due is not None and due <= US0 + watermark * machines.MINUTE:
        out += ({"seq": None, "us": due, **o} for o in machine.expire(s, due))
    return [{"key": key, **o} for o in out]


MACHINES = {
    "guardian": (machines.Guardian(100.0, 0.5, 2, 60), lambda rng: {"pnl": float(rng.integers(-3, 3))}),
    "operational": (machines.Operational(300), lambda rng: {"volatility": float(rng.integers(0, 9)), "base": 4.0, "error_rate": float(rng.random() < 0.2) * 0.1, "latency": None}),
    "capital": (machines.Capital(warmup=3), lambda rng: {"balance": str(rng.choice(["100", "101", "94", "nan", "x", "9"], p=[0.4, 0.4, 0.05, 0.05, 0.05, 0.05])), "ok": bool(rng.random() < 0.9)}),
    "cache": (machines.Cache(1_800), lambda rng: {"op": "put" if rng.random() < 0.4 else "get", "data": str(rng.integers(9)), "ttl": None if rng.random() < 0.7 else 600.0}),
    "cache_inclusive": (machines.Cache(1_800, inclusive=True), lambda rng: {"op": "put" if rng.random() < 0.4 else "get", "data": "d", "ttl": None}),
}


@pytest.mark.parametrize("name", sorted(MACHINES))
def test_machine_over_many_batches(spark, tmp_path, name):
    """Rows of four keys in files of a few hours each, out of order within a file; the stream is broken off and started again."""
    machine, make = MACHINES[name]
    rng = np.random.default_rng(len(name))
    rows = [{"key": int(rng.integers(4)), "seq": i, "m": float(i * 13), **make(rng)} for i in range(120)]  # a tick each 13 minutes
    schema = f"key long, seq long, ts timestamp, {machine.columns}"
    columns = machines.names(machine.columns)
    for begin in range(0, 120, 30):
        part = [rows[begin + i] for i in rng.permutation(30)]
        stream = feed(spark, tmp_path / "in", [(r["key"], r["seq"], at(r["m"]), *(r[c] for c in columns)) for r in part], schema)
        if begin % 60:
            out = run_committed(machines.run_machine(stream, machine, delay="1 second"), str(tmp_path / "out"))
    got = sorted((json.dumps({k: (int(v.timestamp() * 1e6) if k == "ts" else v) for k, v in r.asDict().items()}, sort_keys=True, default=str) for r in out.select("key", "seq", F.col("ts"), *machines.names(machine.output)).collect()))
    want = []
    for k in range(4):
        own = [{c: v for c, v in r.items() if c != "key"} for r in rows if r["key"] == k]
        for o in run_plain(machine, own, k, 119 * 13 - 1 / 60):
            want.append(json.dumps({**{c: v for c, v in o.items() if c != "us"}, "ts": o["us"]}, sort_keys=True))
    assert got == sorted(want)
    assert any(r.seq is None for r in out.collect())


def test_pause_ends_without_a_tick_and_old_rows_change_nothing(spark, tmp_path):
    schema = "key long, seq long, ts timestamp, pnl double"
    machine = machines.Guardian(100.0, 0.5, 2, 60)
    feed(spark, tmp_path / "in", [(1, 1, at(0), -1.0), (1, 2, at(1), -1.0), (2, 3, at(2), 5.0)], schema)
    stream = feed(spark, tmp_path / "in", [(1, 0, at(0.5), -9.0), (2, 4, at(90), 5.0), (2, None, at(91), 5.0), (2, 5, None, 5.0)], schema)
    out = run_committed(machines.run_machine(stream, machine, delay="1 minute"), str(tmp_path / "out")).collect()
    assert [(r.key, r.seq, r.event) for r in sorted(out, key=lambda r: (r.key, r.ts))] == [(1, 1, "trade"), (1, 2, "trade"), (1, None, "lifted"), (2, 3, "trade"), (2, 4, "trade")]
    lifted = next(r for r in out if r.event == "lifted")
    assert lifted.pause_until == US0 + 61 * machines.MINUTE


def numbers(spark, folder, begin, n):
    return feed(spark, folder, [(i, i % 3) for i in range(begin, begin + n)], "i long, k long")


@pytest.mark.parametrize("place", ["before_commit", "after_commit"])
def test_a_batch_is_neither_lost_nor_doubled(spark, tmp_path, place):
    """The run breaks off behind a batch's write and before its commit, or behind its commit and before the checkpoint."""
    stream = numbers(spark, tmp_path / "in", 0, 5)
    numbers(spark, tmp_path / "in", 5, 5)

    def fail(number):
        if number == 1:
            raise RuntimeError("broken off")

    with pytest.raises(StreamingQueryException):
        run_committed(stream, str(tmp_path / "out"), partition_by=["k"], **{place: fail})
    seen = read_committed(spark, str(tmp_path / "out"), stream.schema)
    assert sorted(r.i for r in seen.collect()) == list(range(5 if place == "before_commit" else 10))
    numbers(spark, tmp_path / "in", 10, 5)
    out = run_committed(stream, str(tmp_path / "out"), partition_by=["k"])
    assert sorted((r.i, r.k) for r in out.collect()) == [(i, i % 3) for i in range(15)]
    files = [p for p in (tmp_path / "out" / "data").glob("batch=1/*")]
    assert len(files) == (2 if place == "before_commit" else 1)  # what the broken attempt wrote is there and in no manifest


def test_manifests_are_compacted(spark, tmp_path):
    for i in range(7):
        stream = numbers(spark, tmp_path / "in", i * 2, 2)
    out = run_committed(stream, str(tmp_path / "out"), compact_every=3)
    assert out.count() == 14
    kept = Manifests(spark, str(tmp_path / "out"), 3)
    assert [f.rsplit("/", 1)[1] for f in kept.files()] == ["000000000005.all.json", "000000000006.json"]
    assert [e["batch"] for e in kept.entries()] == list(range(7))
    assert read_committed(spark, str(tmp_path / "nothing"), "i long").collect() == []


def test_complete_mode_reads_the_last_batch(spark, tmp_path):
    numbers(spark, tmp_path / "in", 0, 4)
    stream = numbers(spark, tmp_path / "in", 4, 5)
    out = run_committed(stream.groupBy("k").count(), str(tmp_path / "out"), "complete")
    assert sorted((r.k, r["count"]) for r in out.collect()) == [(0, 3), (1, 3), (2, 3)]


def test_run_available_replaces_a_repeated_batch(spark, tmp_path):
    numbers(spark, tmp_path / "in", 0, 4)
    stream = numbers(spark, tmp_path / "in", 4, 4)
    path = run_available(stream, str(tmp_path / "out"))
    assert sorted(r.i for r in spark.read.parquet(path).collect()) == list(range(8))


def test_a_loss_that_equals_the_limit_is_no_break():
    """Ten trades lose 100 of 1000: added up on the start they come to 899.9999999999999, on their own to -100."""
    machine = machines.Guardian(1000.0, 0.1, 9, 1_440)
    state = dict(machine.initial)
    for us, value in enumerate((46.92, 52.8, 61.55, 9.58, 17.12, 18.41, 67.5, 4.85, 58.26, 63.01)):
        (row,) = machine.step(state, {"pnl": value - 50, "us": us})
    assert row["drawdown"] == 0.1 and row["pause_until"] == 8 + machine.pause  # from the row before on, which broke it


def test_books_keep_their_state_in_the_jvm(spark, tmp_path):
    """A call of the state store for each level, from Python, took minutes at 6 times sf0.1."""
    stream = feed(spark, tmp_path / "in", [(1, [1.0], "delta", "BUY", 1.0, 1.0), (1, [2.0], "snapshot", "SELL", 2.0, 3.0)], BOOK)
    for tops in (False, True):
        assert "TransformWithState" not in machines.book_stream(stream, tops)._jdf.queryExecution().analyzed().toString()
    (top,) = machines.last_tops(run_committed(machines.book_stream(stream, tops=True), str(tmp_path / "out"), "update")).collect()
    assert (top.best_bid, top.bid_size, top.best_ask, top.ask_size, top.mid, top.levels) == (None, 0.0, 2.0, 3.0, None, 1)
