"""Linkage over whole tables and texts, against brute force."""

import itertools

from ladderflow.functions import fuzzy
from ladderflow.operators import link
from ladderflow.plans import catalog

catalog.load()


def parts(spark, folder, n):
    """A part table whose last ids have names of their own."""
    rows = [(i, f"red bolt{'s' if i % 2 else ''}" if i <= 500 else f"green gizmo{i % 3}", f"Brand#{i % 5}", "TIN", i % 50) for i in range(1, n + 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    return rows


def test_best_fuzzy(spark):
    texts = ["red bolt", "bolt red", "red bolts", "green bolt big", "lone", "lone", "", "blue nut", "big green bolt", "red bolt", "nut"]
    rows = [(i, "k" if i % 4 else "j", texts[i * 7 % 11]) for i in range(40)]
    got = {r.left_id: (r.right_id, r.score, r.set_score) for r in link.best_fuzzy(spark.createDataFrame(rows, "id int, kind string, t string")).collect()}
    want = {}
    for i, kind, t in rows:
        near = [(-fuzzy.token_sort_ratio(t, u), j, fuzzy.token_set_ratio(t, u)) for j, other, u in rows if j != i and kind == other and set(t.split()) & set(u.split())]
        if near:
            score, j, set_score = min(near)
            want[i] = (j, -score, set_score)
    assert got == want


def test_fuzzy_queries_read_all_parts(spark, tmp_path):
    rows = parts(spark, tmp_path, 560)
    best = {r.left_id: r for r in catalog.QUERIES["fuzzy_best_match"](spark, str(tmp_path)).collect()}
    assert set(best) == {r[0] for r in rows}
    named = {r.id: r.canonical for r in catalog.QUERIES["fuzzy_dictionary"](spark, str(tmp_path)).collect()}
    assert set(named) == {r[0] for r in rows} and named[560] is not None


def test_tokens_of_whole_texts(spark, tmp_path):
    filler = " ".join(f"w{i}" for i in range(40))
    documents = [(1, f"{filler} Planted passage of some words", "en"), (2, filler, "en"), (3, f" the of\n{filler} the passage", "en"), (4, "the of", "en")]
    benchmark = [(7, "a planted  passage of the words"), (8, "the of it"), (9, "zzzz w39")]
    spark.createDataFrame(documents, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shared = {(i, k): (set(t.lower().split()) & set(u.lower().split()), set(t.lower().split()) | set(u.lower().split())) for i, t in benchmark for k, u, _ in documents}
    got = {(r.left_id, r.right_id): r.common for r in catalog.QUERIES["token_join_min2"](spark, str(tmp_path)).collect()}
    assert got == {p: len(c) for p, (c, _) in shared.items() if len(c) >= 2 and any(len(w) > 3 for w in c)} and (7, 1) in got
    top = {(r.left_id, r.rank): (r.right_id, r.common, r.jaccard) for r in catalog.QUERIES["jaccard_topk"](spark, str(tmp_path)).collect()}
    want = {}
    for i, _ in benchmark:
        ranked = sorted((-len(c), k, int(len(c) / len(u) * 10**6 + 0.5) / 10**6) for (j, k), (c, u) in shared.items() if j == i and c)[:3]
        want |= {(i, n): (k, -c, j) for n, (c, k, j) in enumerate(ranked, 1)}
    assert top == want


def test_token_pairs_of_odd_rows(spark):
    schema = "id long, tokens array<string>"
    left = spark.createDataFrame([(1, ["long", "b", "b"]), (2, []), (3, None), (4, ["b", "c"])], schema)
    right = spark.createDataFrame([(7, ["b", "long", "long"]), (8, None), (9, []), (10, ["c", "b"])], schema)
    pairs = lambda a, b, *least: {(r.left_id, r.right_id): (r.common, r.long) for r in link.token_pairs(a, b, *least).collect()}
    assert pairs(left, right) == {(1, 7): (2, 1)}
    assert pairs(left, right, 1, 0) == {(1, 7): (2, 2), (1, 10): (1, 1), (4, 7): (1, 1), (4, 10): (2, 2)}
    assert pairs(left, right.limit(0)) == pairs(left.limit(0), right) == {}


def test_pairs_of_few_keys_are_dealt_to_all_tasks(spark):
    left = spark.createDataFrame([(i, i % 3 if i % 10 else None) for i in range(90)], "left_id long, k int")
    right = spark.createDataFrame([(i, i % 4) for i in range(70)] + [(5, 1)], "right_id long, k int")
    found = link.dealt_pairs(left, right, ["k"], "left_id", "right_id")
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString() and "strategy=merge" in found._jdf.queryExecution().optimizedPlan().toString()
    want = sorted((a, b) for a in range(90) if a % 10 for b, k in [(i, i % 4) for i in range(70)] + [(5, 1)] if a % 3 == k)
    assert sorted(tuple(r) for r in found.collect()) == want


def test_fuzzy_pairs_of_few_texts_are_dealt_as_lists(spark):
    texts = ["red bolt", "bolt red", "blue nut", "big green bolt", None, ""]
    left = [(i, texts[i % 6]) for i in range(400)]
    right = [(i, texts[i % 7 % 6] if i % 5 else f"{texts[i % 4]} {i % 3}") for i in range(300)] + [(7, "red bolt")]
    frames = [spark.createDataFrame(rows, "id long, t string") for rows in (left, right)]
    found = link.fuzzy_pairs(*frames, share_word=False)
    want = []
    for i, t in left:
        for j, u in right:
            if t and u and (score := (fuzzy.token_sort_ratio(t, u) + fuzzy.token_set_ratio(t, u)) / 2) > 60:
                want.append((i, j, score, score > 75))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and len(want) > link.LIST_IDS**2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # rows are made at the end, behind the joins and in a step of its own, from lists that are dealt to shares
    assert plan.count("explode(left_ids") == 1 and plan.index("explode(right_ids") < plan.index("explode(left_ids") < plan.index("Repartition ") < plan.index("Join Inner") and "share" in plan


def test_dealt_pairs_meet_bounded_lists_and_keep_rows_without_id(spark, monkeypatch):
    """No list of ids grows with its key, and the pairs of two lists come together; a row without id has its pairs, as in SQL."""
    monkeypatch.setattr(link, "MET_IDS", 3, raising=False)
    left = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 0)], "left_id long, k long")
    right = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (7, None)], "right_id long, k long")
    found = link.dealt_pairs(left, right, ["k"], "left_id", "right_id", shares=2)
    want = left.join(right, "k").select("left_id", "right_id")
    assert found.exceptAll(want).count() == 0 and want.exceptAll(found).count() == 0
    rows = [tuple(r) for r in link.dealt_pairs(left, right.where("right_id < 100"), ["k"], "left_id", "right_id", shares=2).collect()]
    runs = [list(g) for _, g in itertools.groupby(rows, key=lambda r: r[0])]
    assert max(map(len, runs)) <= 3
