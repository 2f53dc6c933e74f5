"""Vector codes and the tree search against brute force, and their odd cases."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderflow.llm import nearest_tree, vector_codes
from ladderflow.llm.common import read
from tests import parity

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
#: vec_id, embedding, label: nulls, non-finite and short vectors, repeated rows, rows without vec_id or label.
ODD = [
    (4, [0.5, -0.25, 0.125, 0.0], 1), (2, [0.5, -0.25, 0.125, 0.0], 1), (2, [0.5, -0.25, 0.125, 0.0], None), (None, [1.0, 0.0, 0.0, 0.0], None), (9, None, 1), (8, [NAN, 0.0, 0.0, 0.0], 1),
    (7, [INF, 0.0, 0.0, 0.0], 1), (6, [None, 0.0, 0.0, 0.0], 1), (0, [0.0, 0.0, 0.0, 0.0], 2), (50, [0.25], 2), (3, [], 2), (1, [-0.0, -1.0, 3.0, 2.0], 2), (100, [-0.5, 0.25, -0.125, -0.0], 1),
]
SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, gid long, pos int, leaf int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in ODD], SCHEMA).repartition(3)


def finite(rows):
    return [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def plain_codes(rows, parts, entries, rounds):
    """The contract in plain Python, part by part, without weights."""
    whole = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in finite(rows)]
    width = -(-max(len(v) for _, v, _ in whole) // parts)
    whole = [(i, v + [0] * (width * parts - len(v)), label) for i, v, label in whole]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in whole:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(own[n]) for c in zip(*own[n], strict=True)] if n in own else e for n, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, by_label = [], defaultdict(int)
    for i, v, label in whole:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=str)


def codes(df, **sizes):
    return sorted((tuple(r) for r in vector_codes.compress(vector_codes.integer_rows(df), **sizes).collect()), key=str)


def test_codes_equal_their_sql(spark):
    from ladderflow.llm import queries

    assert parity.differences(spark, parity.duck(SF), queries.op11_vector_codes, vector_codes.ORACLE, SF) == ""


@pytest.mark.parametrize("parts, entries, rounds", [(2, 3, 2), (4, 2, 1), (3, 64, 2), (16, 64, 2)])
def test_codes_of_odd_rows(odd, parts, entries, rounds):
    assert codes(odd, parts=parts, entries=entries, rounds=rounds) == plain_codes(ODD, parts, entries, rounds)


def test_codes_of_random_rows_with_a_hot_vector(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.02, 6).round(2).tolist() if i % 3 else [0.01] * 6, int(i % 4) if i % 5 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert codes(df, parts=3, entries=8) == plain_codes(rows, 3, 8, 2)


def test_parts_that_many_rows_share_are_dealt_out(spark):
    rows = spark.range(9_000).select(F.col("id").alias("rid"), F.when(F.col("id") < 8_000, 1).otherwise(F.col("id")).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("rid").alias("m"))
    got = vector_codes.join_counted(rows, table, ["k"], 9_000)
    assert got.count() == 9_000 and got.where("k = 1 AND m <> 7999").count() == 0 and got.columns == ["k", "rid", "m"]


def test_codes_of_large_components_are_exact(spark):
    rows = [(i, [x, 1.0], 1) for i, x in enumerate([2.0**22, 2.0**22 + 1, -(2.0**22), 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert codes(df, parts=1, entries=2) == plain_codes(rows, 1, 2, 2)
    with pytest.raises(Exception, match="too large"):
        codes(spark.createDataFrame([(1, [1e300], 1)], "vec_id long, embedding array<double>, label int"))


def test_codes_of_nothing(odd):
    assert codes(odd.limit(0)) == [] and codes(odd.where("embedding IS NULL")) == []


def brute(rows, every, k):
    """Each query's list by brute force, one for each row, nearest first."""
    kept = [(n, i, v) for n, (i, v) in enumerate((i, v) for i, v, _ in finite(rows)) if any(v)]
    out = []
    for n, i, v in kept:
        if i is not None and i % every == 0:
            near = lambda w, v=v: sum(a * b for a, b in zip(v, w, strict=False)) / math.sqrt(sum(a * a for a in v)) / math.sqrt(sum(b * b for b in w))
            scored = sorted((-round(near(w), 9) + 0.0, j is None, j or 0) for m, j, w in kept if m != n)[:k]
            out += [(i, r, None if null else j, -s) for r, (s, null, j) in enumerate(scored, 1)]
    return sorted(out, key=str)


def lists(df, every=50, **sizes):
    found = nearest_tree.nearest(df, F.col("vec_id") % every == 0, **sizes).collect()
    return sorted(((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found), key=str)


def test_tree_on_odd_rows(odd):
    """All leaves are visited where so few rows stand: exact lists."""
    assert lists(odd, every=2, recall=1.0) == brute(ODD, 2, 5)
    assert lists(odd, every=2, k=100) == brute(ODD, 2, 100)
    assert lists(odd.limit(0)) == [] and lists(odd.where("vec_id = 0")) == [] and lists(odd.where("vec_id = 100"), every=50) == []


def recall_of(spark, rows, every, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    truth = defaultdict(set)
    for q, _, x, _ in brute(rows, every, 5):
        truth[q].add(x)
    found = nearest_tree.nearest(df, F.col("vec_id") % every == 0, **sizes).collect()
    leaves = {r.leaves for r in found}
    return sum(r.vec_id in truth[r.query_id] for r in found) / sum(map(len, truth.values())), leaves


def test_tree_reaches_its_recall_in_clusters(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(20, 12))
    rows = [(i, (centers[i % 20] + rng.normal(0, 0.3, 12)).tolist(), None) for i in range(2_000)]
    found, leaves = recall_of(spark, rows, 20, leaf_rows=32, block_rows=300, query_rows=20)
    assert found >= 0.9 and max(leaves) < 30  # of some 60 leaves or more


def test_tree_with_a_hot_vector_and_scaled_copies(spark):
    """A third of all rows are one vector, others are multiples of one: exact ties go to the smaller id, and lists are whole."""
    rng = np.random.default_rng(6)
    one = rng.normal(size=4).tolist()
    rows = [(i, one if i % 3 == 0 else [2.0 ** (i % 7) * x for x in (1.0, 2.0, 0.0, -1.0)] if i % 3 == 1 else rng.normal(size=4).tolist(), None) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert lists(df, every=10, recall=1.0, leaf_rows=10, block_rows=40, query_rows=7) == brute(rows, 10, 5)


def test_tree_takes_huge_and_tiny_vectors(spark):
    rows = [(0, [1e200, 1e200], None), (1, [1e-200, 1e-200], None), (2, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = nearest_tree.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 12)) for r in got] == [(1, 1.0), (2, round(math.sqrt(0.5), 12))]


def test_registered_search_has_recall_on_the_table(spark):
    from ladderflow.llm import queries

    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in read(spark, sf, "embeddings").collect()]
    truth = {(q, x) for q, _, x, _ in brute(rows, 50, 5)}
    got = queries.op13_nearest_tree(spark, sf).collect()
    assert len(got) == len(truth) and sum((r.query_id, r.vec_id) in truth for r in got) / len(truth) >= 0.9
    scores = {i: np.array(v) for i, v, _ in rows}
    for r in got:
        a, b = scores[r.query_id], scores[r.vec_id]
        assert r.score == pytest.approx(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b), abs=1e-12)


def test_calibration_narrows_to_the_least_number_of_leaves():
    rng = np.random.default_rng(8)
    x = nearest_tree.unit(rng.normal(size=(500, 5)))
    tree = nearest_tree.Tree(x, 0.04)
    probes = x[:40]
    near = np.argsort(-(probes @ x.T), axis=1)[:, 1:6]
    leaf = tree.assign(x)
    truth = np.array([(p, leaf[j]) for p in range(40) for j in near[p]])
    n, got = nearest_tree.calibrate(tree, probes, truth, 0.9)
    assert got >= 0.9 and sorted(tree.visits(tree.distances(probes[:1])[0])) == list(range(len(tree.leaf)))
    seen = [set(list(tree.visits(d))[: n - 1]) for d in tree.distances(probes)]
    assert np.mean([leaf in seen[p] for p, leaf in truth.tolist()]) < 0.9
