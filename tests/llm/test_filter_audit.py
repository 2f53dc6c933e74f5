"""The filter audit against its SQL and a plain version."""

import re
from itertools import permutations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ladderflow.llm import filter_audit, queries
from tests import parity

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(120))
#: doc_id, text, lang
ODD = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "de"), (1, LONG, None), (None, LONG, "en"), (None, None, None), (3, None, ""), (4, "", "en"), (5, " \t\n", "en"), (6, "A B C", "de"), (7, LONG + " $", "de"),
    (8, "same " * 30_000, "en"), (9, "same " * 30_000, "en"), (10, "Ünï ÇÖDÉ " * 60, "fr"), (11, LONG.upper(), "fr"), (12, "x\x00y\xa0z", "en"), (0, LONG, "en"), (0, LONG, "en"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, None, 1), (6, 1, 1), (None, 1, 1), (99, 1, 1), (8, 0, 0), (0, 1, 0)]


def plain(rows, labels):
    """The contract in plain Python."""
    lowest = {}
    for i, t, _ in rows:
        if i is not None:
            lowest[t or ""] = min(i, lowest.get(t or "", i))
    docs = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > lowest[t]}
        own = [(q, x) for d, q, x in labels if i is not None and d == i]
        docs.append((lang or "", {f for f in fails if fails[f]}, any(q == 1 for q, _ in own), any(x == 1 for _, x in own)))
    out, orders = {}, ["".join(p) for p in permutations("ABCDE")]
    for part in {d[0] for d in docs}:
        mine = [d[1:] for d in docs if d[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in orders:
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [d for d in mine if f in d[0] and not d[0] & before]
                removed_by[f] += len(removed)
                kept = sum(not d[0] & (before | {f}) for d in mine)
                redundant, unique = sum(f in d[0] and bool(d[0] & before) for d in mine), sum(d[0] == {f} for d in mine)
                out[part, order, step] = [kept, len(removed), redundant, unique, sum(d[1] for d in removed), sum(d[2] for d in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(docs, labels):
    got = filter_audit.audit(docs, labels).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 1, "x", True, b"1") for r in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, mask int, part string, tail boolean, digest binary").repartition(5)
    return docs, spark.createDataFrame([(*r, 1) for r in LABELS], "doc_id long, quality int, toxic int, n int")


def test_audit_equals_its_sql(spark):
    assert parity.differences(spark, parity.duck(SF), queries.op12_filter_audit, filter_audit.ORACLE, SF) == ""


@pytest.mark.parametrize("partitions", ["1", "4", "29"])
def test_audit_of_odd_rows(spark, odd, partitions):
    """Whatever the ranges, the copies of a text are found over their boundaries."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert audited(*odd) == plain(ODD, LABELS)
        hot = [(i, "same words here" if i % 3 else f"text {i % 5}", "en" if i % 7 else "de") for i in range(500)]
        docs = spark.createDataFrame(hot, "doc_id long, text string, lang string").repartition(9)
        assert audited(docs, odd[1]) == plain(hot, LABELS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_copies_lie_in_several_ranges(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"), F.lit("en").alias("lang"))
    sizes = docs.withColumn("fp", F.xxhash64("text")).repartitionByRange(6, "fp", "doc_id").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 6 and max(r["count"] for r in sizes) < 1_000


def test_nothing_gives_nothing(odd):
    assert audited(odd[0].limit(0), odd[1]) == {}
    assert audited(odd[0], odd[1].limit(0)) == plain(ODD, [])


def marked(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("fp", pa.int64()), ("text", pa.string()), ("mask", pa.int32())])
    return [r for b in filter_audit._mark(pa.RecordBatch.from_pylist([{"doc_id": i, "part": "p", "fp": fp, "text": t, "mask": 0} for i, fp, t in rows], schema=schema) for rows in batches) for r in b.to_pylist()]


def test_runs_go_on_over_batches_and_fingerprints_may_collide():
    """Two texts with one fingerprint, cut between batches: every copy is marked, open rows and tails are those of the range's
    first and last fingerprint."""
    rows = [(1, 5, "a"), (4, 5, "a"), (4, 5, "a"), (None, 5, "a"), (2, 5, "b"), (3, 5, "b"), (7, 6, "c"), (8, 6, "c")]
    for cuts in ([8], [1, 8], [2, 5, 8], [1, 2, 3, 4, 5, 6, 7, 8], [4, 4, 8]):
        out = marked([rows[a:b] for a, b in zip([0, *cuts], cuts, strict=False)])
        own = [r for r in out if not r["tail"]]
        assert [r["mask"] for r in own] == [0, 16, 16, 0, 0, 16, 0, 16]
        assert [r["digest"] is not None for r in own] == [True, False, False, False, True, False, False, False]
        assert [(r["doc_id"], r["fp"]) for r in out if r["tail"]] == [(7, 6)]
    assert {r["doc_id"] for r in marked([rows[:6]]) if r["tail"]} == {1, 2}
