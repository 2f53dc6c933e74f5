"""Streams against their batch twins, replay and risk against hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ladderflow.operators import backtest, risk
from ladderflow.plans import catalog
from ladderflow.sources import readers, schemas, sinks
from ladderflow.streaming import ticks as streaming

catalog.load()
SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def test_stream_signals_equal_batch(spark):
    key = lambda df: sorted(tuple(r) for r in df.select("seq", "key", "profit").collect())
    assert key(catalog.QUERIES["stream_signals"](spark, SF)) == key(catalog.QUERIES["signal_dedup_ttl"](spark, SF))


def test_stream_over_many_files_drops_late_ticks(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(minutes=i), i % 2, "A" if i % 3 else "B", float(i)) for i in range(40)]
    schema = "seq long, ts timestamp, mapping long, side string, value double"
    for i in range(0, 40, 10):
        spark.createDataFrame(rows[i : i + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.latest_prices(streaming.read_ticks(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1))
    out = spark.read.parquet(streaming.run_available(stream, str(tmp_path / "out")))
    last = {r.mapping: (r.a, r.b) for r in out.orderBy("seq").collect()}
    assert out.count() <= 40 and set(last) == {0, 1}


@pytest.mark.parametrize("drop", [True, False])
def test_replay(spark, drop):
    snaps = spark.createDataFrame([(1, T0, "t", 0.1, 0.2), (1, T0 + dt.timedelta(1), "t", 0.8, 0.9), (1, T0 + dt.timedelta(2), "t", 0.8, 0.9)], "run_id long, ts timestamp_ntz, token_id string, best_bid double, best_ask double")
    rows = backtest.replay(snaps, backtest.dip_strategy(0.3, 0.7, 100.0), 1000.0, drop).orderBy("ts").collect()
    assert [(r.side, r.size) for r in rows] == [("BUY", 100.0), ("SELL", 100.0)]
    assert rows[-1].capital == pytest.approx(1000 - 20 + 80)


def test_dedup_and_rate_limit(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, at(0), "k", 3.0), (2, at(10), "k", 5.0), (3, at(20), "k", 8.0), (4, at(30), "k", 9.0), (5, at(4000), "k", 1.0)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp, key string, profit double")
    assert sorted(r.seq for r in backtest.dedup_signals(df).collect()) == [1, 3, 5]
    assert sorted(r.seq for r in backtest.rate_limit(df.drop("profit"), 15).collect()) == [1, 3, 5]


def test_api_breaker(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, at(0), 1, False), (2, at(1), 1, False), (3, at(2), 1, False), (4, at(3), 1, True), (5, at(70), 1, True), (6, at(71), 1, True)]
    got = backtest.api_breaker(spark.createDataFrame(rows, "seq long, ts timestamp, key long, ok boolean")).orderBy("seq").collect()
    assert [(r.allowed, r.state) for r in got] == [(True, "CLOSED"), (True, "CLOSED"), (True, "OPEN"), (False, "OPEN"), (True, "CLOSED"), (True, "CLOSED")]


def test_balances_fail_closed(spark):
    raw = spark.createDataFrame([(x,) for x in (None, "NaN", "inf", "invalid", "5", "100.50")], "b string")
    assert [r.x for r in raw.select(risk.validated_balance(F.col("b")).alias("x")).collect()] == [0, 0, 0, 0, 5, 100.5]


def test_streaks_end_at_rows_without_value(spark):
    """As in SQL and in the stream's machine: a row without value is no loss, ends a streak and counts as none."""
    values = [None, 49.0, 48.0, None, 40.0, 30.0, 20.0, 10.0, 60.0, None]
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 1, v) for i, v in enumerate(values)], "seq long, ts timestamp, key long, value double")
    got = risk.guardian(rows, F.col("value") - 50, 1000.0, losers=4).orderBy("seq").collect()
    assert [r.streak for r in got] == [0, 1, 2, 0, 1, 2, 3, 4, 0, 0]
    assert [r.pause_until is not None for r in got] == [i >= 7 for i in range(10)]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01T00:00:00", "c", "t", "Yes", 0.5, 0.4, 0.6, 1.0, 1.0, 0.2), ("2024-01-02T00:00:00", "c", "u", "Yes", 0.5, 0.4, 0.6, 1.0, 1.0, 0.2)], schemas.SNAPSHOT)
    sinks.append_by_day(df, str(tmp_path / "s"))
    assert readers.count_snapshots(spark, str(tmp_path / "s")) == 2
    assert [r.token_id for r in readers.snapshots(spark, str(tmp_path / "s"), "2024-01-01", "2024-01-01T99", ["t", "u"]).collect()] == ["t"]
    (tmp_path / "m.txt").write_text("# help\nlatency_sum 12.5\nbroken x\n")
    assert [tuple(r) for r in readers.prometheus(spark, str(tmp_path / "m.txt")).collect()] == [("latency_sum", 12.5)]
    (tmp_path / "d.json").write_text('{"soccer": {"Real Madrid": ["RMA", "Real"]}}')
    assert {(r.sport, r.canonical, r.alias) for r in readers.dictionary(spark, str(tmp_path / "d.json")).collect()} == {("soccer", "Real Madrid", a) for a in ("Real Madrid", "RMA", "Real")}
    (tmp_path / "h.csv").write_text("Date,HomeTeam,AwayTeam,FTR,B365H,B365D,B365A\n1,a,b,H,1.5,3,4\n2,a,b,H,x,3,4\n")
    assert readers.csv_rows(spark, str(tmp_path / "h.csv"), schemas.ODDS_HISTORY).select("Date", "B365H").collect()[0].B365H == 1.5
    sinks.to_csv(spark.createDataFrame([(1.239,)], "ev double"), str(tmp_path / "c"), ["ev"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().ev == "1.24%"
    sinks.to_json_lines(spark.createDataFrame([(T0, "a", "b", 0.9)], "ts timestamp, left string, right string, score double"), str(tmp_path / "j"), "match")
    assert readers.json_lines(spark, str(tmp_path / "j"), ["match"]).select("data.left").first()[0] == "a"
    moves = spark.createDataFrame([(1, "0xA", "0xB"), (5, "0xa", "0xC"), (6, "0xd", "0xA"), (7, "0xd", "0xe")], "block long, from string, to string")
    got = readers.transfers(moves, spark.createDataFrame([("0xA",)], "wallet string"), 1).orderBy("block").collect()
    assert [(r.block, r.side) for r in got] == [(5, "SELL"), (6, "BUY")]


def test_ordered_rows_of_many_keys_stream_through(spark):
    """Keys without rows between them, a null key, a row without time or profit: the state begins anew at each key, and no key is a group of its own."""
    rows = [(i, T0 + dt.timedelta(seconds=i), None if i % 5 == 4 else f"k{i % 5}", float(i)) for i in range(50)] + [(90, None, "k0", 200.0), (91, T0 + dt.timedelta(seconds=49), "k0", None)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp, key string, profit double")
    sent = backtest.dedup_signals(df, 1e9, 20.0)
    assert "FlatMapGroups" not in sent._jdf.queryExecution().analyzed().toString()
    want = {f"k{i}": [i, i + 20, i + 40] for i in range(4)} | {None: [4, 24, 44]}
    want["k0"].append(90)
    got = {}
    for r in sent.orderBy("seq").collect():
        got.setdefault(r.key, []).append(r.seq)
    assert got == want


def test_signals_of_a_group_keep_their_own_state(spark, tmp_path):
    """Forty keys in two groups over three batches send what the batch twin sends; the stream's groups are not its keys."""
    schema = "seq long, ts timestamp, key string, profit double"
    rows = [(i, T0 + dt.timedelta(minutes=i), f"k{i % 40}", float(i * 7 % 50)) for i in range(240)]
    for i in range(0, 240, 80):
        spark.createDataFrame(rows[i : i + 80], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.read_ticks(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
    sent = streaming.refiring_signals(stream, 6_000.0, groups=2)
    got = sorted(tuple(r) for r in spark.read.parquet(streaming.run_available(sent, str(tmp_path / "out"))).collect())
    assert got == sorted(tuple(r) for r in backtest.dedup_signals(spark.createDataFrame(rows, schema), 6_000.0).collect()) and 40 < len(got) < 240
