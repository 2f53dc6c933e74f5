"""Pruned scans, seeding with a log, new aliases, counters of a scan, cascaded answers, the online model."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderflow.operators import answers, polytope
from ladderflow.sources import readers, schemas, seeding, sinks


def snapshot_rows(spark):
    rows = [(f"2024-01-{d:02d} {h:02d}:30:00", "c", f"t{(d * 7 + h) % 9}", "Yes", 0.5, 0.4, 0.6, 1.0, 1.0, 0.2) for d in range(1, 11) for h in range(0, 24, 5)]
    return spark.createDataFrame([*rows, ("2024-01-05 unknown", "c", "t1", "Yes", 0.5, 0.4, 0.6, 1.0, 1.0, 0.2)], schemas.SNAPSHOT)


@pytest.mark.parametrize("buckets", [0, 3])
def test_scan_lists_only_the_days_and_buckets_that_are_asked_for(spark, tmp_path, buckets):
    df = snapshot_rows(spark)
    sinks.append_by_day(df, str(tmp_path / "s"), buckets=buckets)
    start, end, tokens = "2024-01-03 12:00:00", "2024-01-06 04:00:00", ["t1", "t4"]
    plain = lambda x: sorted(tuple(r) for r in x.select("timestamp", "token_id").collect())
    for some in (None, tokens):
        want = df.where(F.col("timestamp").between(start, end))
        got = readers.snapshots(spark, str(tmp_path / "s"), start, end, some)
        assert plain(got) == plain(want.where(F.col("token_id").isin(some)) if some else want) and got.count() > 2
    stamps = [r.timestamp for r in readers.snapshots(spark, str(tmp_path / "s"), start, end).collect()]
    assert stamps == sorted(stamps)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    got = readers.snapshots(spark, str(tmp_path / "s"), start, end, tokens, in_order=False)
    filters = got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("PushedFilters")[0]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "date" in filters and (not buckets or "bucket_of_3" in filters)
    files = {r.f for r in got.select(F.input_file_name().alias("f")).distinct().collect()}
    assert all(any(f"date=2024-01-{d}" in f or "__HIVE_DEFAULT" in f for d in ("03", "04", "05", "06")) for f in files)


def test_seeding_goes_on_behind_what_is_done(spark, tmp_path):
    entities = spark.createDataFrame([(str(i % 5), f"Team {i}", None if i % 4 == 0 else f"T{i}") for i in range(40)] + [("1", "Team 1", "T1"), ("2", None, "X")], "league string, name string, code string")
    leagues = spark.createDataFrame([(str(i),) for i in range(7)] + [("3",), (None,)], "league string")  # 5 and 6 have no entities
    asked: list[str] = []

    def fetch(some, broken=None):
        mine = [r.league for r in some.collect()]
        asked.extend(mine)
        if broken is not None and len(asked) >= broken:
            raise OSError("broken off")
        return entities.join(some, "league", "left_semi")

    root = str(tmp_path / "seeds")
    with pytest.raises(OSError):
        seeding.seed(spark, leagues, lambda some: fetch(some, 3), root, chunk=2)
    first = {r.league for r in seeding.done_leagues(spark, root).collect()}
    assert 0 < len(first) < 7 and {r.league for r in seeding.seeded(spark, root).select("league").collect()} <= first
    asked.clear()
    rows = seeding.seed(spark, leagues, fetch, root, chunk=2)
    assert not set(asked) & first and set(asked) | first == {str(i) for i in range(7)}
    got = sorted(tuple(r) for r in rows.collect())
    assert got == sorted(tuple(r) for r in seeding.alias_rows(entities).collect()) and len(got) == len(set(got))
    asked.clear()
    assert sorted(tuple(r) for r in seeding.seed(spark, leagues, fetch, root).collect()) == got and asked == []


def test_new_aliases(spark):
    rows = [("Real Madrid", "Los Blancos"), ("Real Madrid", " real madrid "), ("Barcelona", "Barca"), ("Barcelona", ""), (None, "x"), ("", "y"), ("Betis", None), ("B", "los blancos"), ("Betis", "  ")]
    got = readers.new_aliases(spark.createDataFrame(rows, "label string, alt string"), spark.createDataFrame([("barca",)], "alias string"))
    assert [tuple(r) for r in got.select("alias", "label").collect()] == [("los blancos", "B")]


def test_discovery_counters(spark):
    rows = [(1, True, False, ["a", "b"]), (1, True, None, ["a"]), (1, None, False, ["a", "b"]), (2, True, True, ["a", "b"]), (2, True, False, None)]
    got = {r.page: (r.markets, r.accepting, r.tradeable, r.two_sided) for r in readers.discovery_counters(spark.createDataFrame(rows, "page long, accepting_orders boolean, closed boolean, tokens array<string>")).collect()}
    assert got == {1: (3, 2, 2, 1), 2: (2, 2, 1, 0), None: (5, 4, 3, 1)}


def test_answers_cascade(spark):
    good, bad = '{"is_arb": true, "confidence": 0.9, "reason": "gap"}', "I do not know, and this is a long answer without any object in it"
    rows = [(0, 0.1, good, "Y", good), (1, 2.0, good, "N", None), (2, 2.0, None, "y", f"So {good}"), (3, None, None, "N", bad), (4, 2.0, None, None, '{"is_arb": true}'), (5, 2.0, None, "N", good), (6, 2.0, None, "Y", None)]
    df = spark.createDataFrame(rows, "id int, ev_net double, cached string, quick string, deep string")
    as_rows = lambda x: {r.id: (r.is_opportunity, r.confidence, r.reasoning, r.source) for r in x.collect()}
    got = as_rows(answers.cascade(df))
    assert got[0] == (False, 0.0, "EV 0.10% below threshold", "math_filter") and got[1] == (True, 0.9, "gap", "cache") and got[2] == (True, 0.9, "gap", "primary")
    assert got[3] == (False, 0.3, bad[:50], "primary") and got[4] == (True, 0.0, "Analysis complete", "primary") and got[5][3] == "primary" and got[6] == (False, 0.3, "", "primary")
    sure = as_rows(answers.cascade(df, no=0.8))
    assert sure[5] == (False, 0.3, "Quick check negative", "quick") and sure[3][3] == "quick" and sure[4][3] == "primary"


def test_online_model_equals_the_plain_one(spark):
    """One ordered pass for each key, step by step."""
    rng = np.random.default_rng(5)
    rows = [(int(k), int(s), int(s), float(x), float(z), int(y)) for s, (k, x, z, y) in enumerate(zip(rng.integers(0, 3, 90), rng.random(90), rng.normal(size=90), rng.integers(0, 2, 90), strict=True))]
    df = spark.createDataFrame(rows, "key long, ts long, seq long, x double, z double, y int").repartition(5)
    got = {r.key: r.weights for r in polytope.online_ensemble(df, ["x", "z"], "y", rate=0.1, decay=0.95).collect()}
    for key in range(3):
        w = [0.0, 0.0, 0.0]
        for _, _, _, x, z, y in (r for r in rows if r[0] == key):
            v = (x, z, 1.0)
            error = y - 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, v, strict=True))))
            w = [0.95 * a + 0.1 * error * b for a, b in zip(w, v, strict=True)]
        assert got[key] == pytest.approx(w)


def test_a_move_that_rounding_makes_has_no_side(spark, tmp_path):
    """11.12 is 10 above 1.12, but not as large as 1.12 + 10: SQL names no side."""
    from ladderflow.plans import catalog

    catalog.load()
    rows = [(1, dt.datetime(2024, 1, 1), 1, "x", 1.12, ""), (2, dt.datetime(2024, 1, 2), 1, "x", 11.12, ""), (3, dt.datetime(2024, 1, 3), 1, "x", 90.0, ""), (4, dt.datetime(2024, 1, 4), 1, "x", 70.0, "")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert {r.seq: r.fill for r in catalog.QUERIES["quote_crossing_fills"](spark, str(tmp_path)).collect()} == {2: None, 3: "SELL", 4: "BUY"}
