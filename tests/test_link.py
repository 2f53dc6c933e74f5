"""Known pairs of names and titles, and band joins against all pairs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ladderflow.functions import fuzzy, predicates
from ladderflow.functions import text as T
from ladderflow.operators import graph, link
from ladderflow.plans import catalog

catalog.load()


@pytest.mark.parametrize(
    ("a", "b", "sport", "fits"),
    [
        ("Drake vs Illinois", "Illinois vs Drake", "basketball", True), ("Drake vs Illinois", "Illinois State vs Drake", "basketball", False),
        ("Virginia Tech vs Duke", "Duke vs Virginia", "basketball", False), ("Michigan State vs Ohio State", "Ohio State vs Michigan State", "basketball", True),
    ],
)
def test_overlap(spark, a, b, sport, fits):
    assert spark.range(1).select(link.overlap(F.lit(a), F.lit(b), sport).alias("x")).first().x is fits


def test_predicates(spark):
    at = lambda h: F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h))
    row = spark.range(1).select(
        predicates.within_day(at(0), at(23)).alias("a"), predicates.within_day(at(0), at(25)).alias("b"), predicates.within_day(at(0), at(-25)).alias("c"), predicates.within_hours(F.lit(None).cast("timestamp"), at(9)).alias("d"),
        predicates.compatible_totals(F.lit("Over 2.5 goals?"), F.lit("Yes"), F.lit("Over 2.5 Goals")).alias("e"), predicates.compatible_totals(F.lit("Over 2.5 goals?"), F.lit("Yes"), F.lit("Over 1.5 Goals")).alias("f"),
        predicates.compatible_totals(F.lit("Will it be a draw?"), F.lit("Yes"), F.lit("The Draw")).alias("g"), predicates.compatible_totals(F.lit("Will it be a draw?"), F.lit("Yes"), F.lit("Team A")).alias("h"),
        (T.fingerprint(F.lit("Over 2.5"), F.lit("OVER_UNDER_25")) == T.fingerprint(F.lit("Under 2.5"), F.lit("OVER_UNDER_25"))).alias("i"), F.array_contains(T.person_aliases(F.lit("Jannik Sinner")), "j. sinner").alias("j"),
    ).first()
    assert tuple(row) == (True, False, False, True, True, False, True, False, True, True)


def test_fuzzy():
    assert fuzzy.token_sort_ratio("b a", "A b") == 100 and fuzzy.token_set_ratio("man city", "manchester city fc city man") == 100
    assert fuzzy.ratio("abcd", "abed") == 75 and fuzzy.token_sort_ratio("", "x") == 0
    score = 0.7 * fuzzy.token_set_ratio("Jannik Sinner vs C. Alcaraz", "J. Sinner v Carlos Alcaraz") + 30
    assert score > 60
    for a, b in [("kitten", "sitting"), ("", "abc"), ("same", "same")]:
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
        assert fuzzy.common_subsequence(a, b) == table[-1][-1]


def test_band_join_meets_each_pair_once(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i * 5), ["r0", "r1", "global"][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, region string")
    got = sorted((r.left_id, r.right_id) for r in link.band_join(df, df).collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows if abs(a[1] - b[1]) < dt.timedelta(hours=24) and (a[2] == b[2] or b[2] == "global"))
    assert got == want


def test_band_join_meets_lists_of_ids(spark, monkeypatch):
    """One join, of left rows with lists of right ids; ids are laid out behind it. Null and repeated ids, lists of several pieces, unnamed
    and global regions and rows without time give the pairs of the plain condition."""
    import random

    monkeypatch.setattr(link, "GROUPED_IDS", 3)
    pick = random.Random(5)
    rows = lambda n, ids: [(pick.choice(ids), dt.datetime(1969, 12, 30) + dt.timedelta(hours=pick.randrange(96)), pick.choice(["r1", "r2", "global", None])) for i in range(n)]
    schema, noon = "id long, ts timestamp, region string", dt.datetime(1970, 1, 1, 12)
    a = [*rows(60, [None, *range(20)]), (21, None, "r1"), (22, noon, "r1")]
    b = [*rows(60, [None, *range(20)]), (31, None, "global"), *[(i % 7 + 40, noon, "r1") for i in range(14)], *[(None, noon, "global")] * 4]
    day = dt.timedelta(hours=24)
    want = [(x, y, abs(s - t) // dt.timedelta(microseconds=1)) for x, s, p in a for y, t, r in b if s and t and abs(s - t) < day and (r == "global" or (p and p == r))]
    found = link.band_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, found.select("left_id", "right_id", "gap").collect()), key=key) == sorted(want, key=key)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Union" not in plan and plan.index("Generate explode(right_ids") < plan.index("Join"), plan


def test_components(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("d", "e", 1.0), *[(f"k{i:02}", f"k{i + 1:02}", 1.0) for i in range(30)]], "u string, v string, weight double")
    got = {r.id: r.component for r in graph.components(edges).collect()}
    assert got["c"] == "a" and got["e"] == "d" and {got[f"k{i:02}"] for i in range(31)} == {"k00"}


def test_dictionary(spark):
    aliases = spark.createDataFrame([("s", "Man Utd", "Manchester United", 1), ("s", "Man Utd", "Other", 0), ("t", "x", "y", 0)], "sport string, alias string, canonical string, version int")
    names = spark.createDataFrame([(1, "s", " MAN UTD "), (2, "s", "man utds"), (3, "t", "zzz")], "id int, sport string, name string")
    assert {r.id: r.canonical for r in link.resolve_exact(names, aliases).collect()} == {1: "Manchester United", 2: None, 3: None}
    last = aliases.where("version > 0 or sport = 't'")
    assert {r.id: r.canonical for r in link.resolve_fuzzy(names, last).collect()} == {1: "Manchester United", 2: "Manchester United", 3: None}


def test_nearest_match_makes_no_pairs(spark):
    """The first of all pairs by gap and id, also at bucket ends, at equal times, of global and of unnamed regions; no plan joins."""
    import random

    pick = random.Random(3)
    rows = lambda n, start: [(start + i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=pick.randrange(240)), pick.choice(["r1", "r2", "global", None])) for i in range(n)]
    schema = "id long, ts timestamp, region string"
    left = spark.createDataFrame([*rows(80, 0), (90, None, "r1"), (91, dt.datetime(2030, 1, 1), "r1")], schema)
    right = spark.createDataFrame([*rows(30, 100), (190, None, "global"), (191, dt.datetime(2024, 1, 5), "r1"), (192, dt.datetime(2024, 1, 5), "r1")], schema)
    want = sorted(map(tuple, link.first_match(link.band_join(left, right), "gap", "right_id").select("left_id", "right_id", "gap").collect()))
    found = link.nearest_match(left, right)
    assert want and sorted(map(tuple, found.collect())) == want
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["blocked_first_match", "audit_summary", "shadow_cycle", "unmatched_antijoin"])
def test_nearest_queries_make_no_pairs(spark, monkeypatch, name):
    def none(*_, **__):
        raise AssertionError("all pairs of a band")

    monkeypatch.setattr(link, "band_join", none)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").columns


def test_mentioned_never_broadcasts_texts(spark):
    texts = spark.createDataFrame([(1, "Red Bull vs red star"), (2, "blue"), (3, None)], "id long, text string")
    aliases = spark.createDataFrame([("red", "RED"), ("red star", "RS"), ("bu", "X"), ("blue", "B")], "alias string, canonical string")
    for most, hint in ((10, "strategy=broadcast"), (0, "strategy=merge")):
        found = link.mentioned(texts, aliases, most_broadcast=most)
        assert {r.id: r.canonicals for r in found.collect()} == {1: ["RED", "RS"], 2: ["B"]}
        joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
        assert joins and all(f"rightHint=({hint})" in line and "leftHint=(strategy=broadcast)" not in line for line in joins), joins
