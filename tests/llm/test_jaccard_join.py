import re

import numpy as np
import pytest

from ladderflow.llm import jaccard_join as J


def brute(docs):
    """(set size, smallest doc_id reachable) by comparing all pairs."""
    sets = {}
    for i, text in docs:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def families(rng, n_families=6, copies=14, words=120):
    """Families of copies with many and few edits, that share a passage."""
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [str(x) for x in rng.choice(vocabulary, 30)]
    docs, i = [], 0
    for _ in range(n_families):
        base = [str(x) for x in rng.choice(vocabulary, words)] + passage
        for _ in range(copies):
            own = list(base)
            for at in rng.integers(0, len(own), rng.integers(0, 6)):
                own[at] = str(rng.choice(vocabulary))
            docs.append((i * 7 + 3, " ".join(own)))
            i += 1
    for _ in range(25):
        docs.append((i * 7 + 3, " ".join([str(x) for x in rng.choice(vocabulary, rng.integers(1, 60))] + passage)))
        i += 1
    return docs


SMALL = {"hot_count": 2, "block": 3000, "salt_rows": 5, "part_rows": 4}


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, SMALL), (3, SMALL)])
def test_components_equal_brute_force(spark, seed, sizes):
    docs = families(np.random.default_rng(seed))
    docs += [(5, None), (6, ""), (8, " \n\t "), (9, "a b c"), (11, "A b  c"), (12, "a b c d"), (13, "x " * 4000), (14, "x " * 9000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, k1 string").repartition(5)
    rows = J.join(df, **sizes).collect()
    expected = brute(docs)
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert len({c for _, c in expected.values()}) < len(docs) - 40


def test_repeated_rows_null_ids_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string"
    long = " ".join(f"t{i}" for i in range(50))
    df = spark.createDataFrame([(4, long, "a"), (4, long, "b"), (2, long, None), (None, long, "c"), (7, None, None)], schema)
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join(df).collect()), key=str)
    assert rows == sorted([(4, 46, 2), (4, 46, 2), (2, 46, 2), (None, 46, None), (7, 0, 7)], key=str)
    kept = J.keep_one(df).collect()
    assert {(r.doc_id, r.lang) for r in kept} == {(2, None), (None, "c"), (7, None)} and len(kept) == 3
    assert J.join(df.limit(0)).collect() == []


def test_tree_loses_no_pair():
    rng = np.random.default_rng(5)
    n, bits, comp = [], [], []
    sets = []
    for i in range(90):
        base = sets[rng.integers(len(sets))] if sets and rng.random() < 0.7 else rng.integers(0, 2**63, rng.integers(5, 80)).astype(np.uint64)
        own = base.copy()
        own[rng.integers(0, len(own), rng.integers(0, 6))] = rng.integers(0, 2**63)
        own = np.unique(own)
        sets.append(own)
        n.append(len(own))
        bits.append(J.fold([J.bitmap(own)], J.BITS)[0])
        comp.append(i // 4)
    a, b = J.SignatureTree(np.array(n), np.array(bits), np.array(comp), 4).pairs()
    found = {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}
    for i in range(90):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if comp[i] != comp[j] and 9 * common >= 4 * (len(sets[i]) + len(sets[j])):
                assert frozenset((i, j)) in found
    assert len(found) < 90 * 89 / 4


def test_wide_bitmaps_fold_and_never_lose_a_link():
    rng = np.random.default_rng(8)
    big = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    near = np.unique(np.r_[big[150:], rng.integers(0, 2**63, 100).astype(np.uint64)])
    far = np.unique(np.r_[big[:900], rng.integers(0, 2**63, 2000).astype(np.uint64)])
    small = np.unique(rng.integers(0, 2**63, 700).astype(np.uint64))
    sets = [big, near, far, small]
    raw = [J.bitmap(s) for s in sets]
    assert [len(r) * 8 for r in raw] == [4096, 4096, 4096, 1024]
    assert (J.fold(raw[:1], 1024)[0] == J.fold([J.bitmap(big)], 1024)[0]).all()
    n = np.array([len(s) for s in sets])
    assert J.pairs_may_link(n, raw, np.array([0, 0, 0]), np.array([1, 2, 3])).tolist() == [True, False, False]
