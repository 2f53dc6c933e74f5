"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator, and brute-force
versions of those that SQL cannot express."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ladderflow.llm import fingerprint, knn, license_scan, line_dedup, pii, sentencepieces, token_count, toxicity
from tests import parity

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "one", "two words", "two words", "Ünï çödé 你好 😀", "under the MIT License. cc by nc", "x" * 30_000, "word " * 8_000, "\n\n", "tab\tand\x00nul"]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with extra columns named like those of the operators."""
    rows = [(i, t, "s", 1, [1], True, 0.5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n int, base array<int>, tail boolean, score double").repartition(3)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_sentencepiece(docs, real):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = by_id(sentencepieces.encode(docs, MODEL))
    assert {i: got[i].ids for i in got} == {i: library.encode(t or "") for i, t in enumerate(TEXTS)}
    back = by_id(sentencepieces.decode(sentencepieces.encode(docs, MODEL), MODEL))
    assert {i: back[i].text for i in back} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert all(r.round_trip for r in sentencepieces.digest(docs, MODEL).collect())
    for r in sentencepieces.encode(real.limit(60), MODEL).join(real, "doc_id").collect():
        assert r.ids == library.encode(r.text)
    assert sentencepieces.digest(docs.limit(0), MODEL).collect() == []


def test_sentencepiece_of_a_unigram_model():
    """Scores decide in unigram models: the best path over all segmentations."""
    p = sentencepieces.Pieces(MODEL)
    p.bpe = False
    rng = np.random.default_rng(1)
    p.score = rng.normal(-5, 2, len(p.score))
    for word in ["▁abc", "▁the", "ing", "▁xyzzy"]:
        best = max(_segmentations(word, p.piece), key=lambda s: sum(p.score[p.piece[x]] for x in s))
        assert [p.names[i] for i in p.viterbi([word])[0]] == best


def _segmentations(word, pieces):
    if not word:
        yield []
    for i in range(1, len(word) + 1):
        if word[:i] in pieces:
            for rest in _segmentations(word[i:], pieces):
                yield [word[:i], *rest]


def test_license_scan(spark, docs):
    got = by_id(license_scan.digest(license_scan.scan(docs)))
    r = got[7]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (7, 2, 0, 4, "cc-by-nc,mit", "cc-by-nc,mit", 1.0)
    assert (got[0].n_words, got[0].labels, got[0].first_word, got[0].score) == (0, "", None, 0.0) and got[9].n_words == 8000
    words = {i: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for i, t in enumerate(TEXTS)}
    assert {i: got[i].n_words for i in got} == words
    other = spark.createDataFrame([(1, "Licensed under the GNU General Public License, version 3. cc by-nc CC BY  NC the mit license")], "doc_id long, text string")
    assert (r := license_scan.digest(license_scan.scan(other)).first()).labels == "cc-by-nc,gpl,gpl-3,mit" and r.n_base == 2
    assert license_scan.digest(license_scan.scan(docs.limit(0))).collect() == []


def test_token_count(docs):
    import regex

    vocabulary = set(token_count.vocabulary(BPE))
    longest = max(map(len, vocabulary))

    def greedy(word):
        n = at = 0
        while at < len(word):
            at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary)
            n += 1
        return n

    for i, r in by_id(token_count.count_tokens(docs, BPE)).items():
        words = regex.findall(token_count.PATTERN, TEXTS[i] or "")
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(w.encode()) for w in words))
    tiny = token_count.LongestMatch([bytes([c]) for c in range(256)] + [b"ab", b"abcd", b"bcx", b"cdef"])
    assert tiny.count_words([b"", b"abcx", b"abcdef", b"abcde", b"zab"]).tolist() == [0, 3, 3, 2, 2]
    assert token_count.count_tokens(docs.limit(0), BPE).collect() == []


def best_of(rows, k):
    """Brute force over all rows: {row of the query: [(rank, vec_id, score)]}, integers of any size."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in kept]
    out = {}
    for n, (q, a) in enumerate(whole):
        if q is not None and q % 20 == 0:
            scored = [(-sum(x * y for x, y in zip(a, b, strict=False)), x is None, x or 0) for m, (x, b) in enumerate(whole) if m != n]
            out[n] = [(r, None if null else x, -s) for r, (s, null, x) in enumerate(sorted(scored)[:k], 1)]
    return whole, out


def same_lists(found, expected, whole):
    """Each query's list, those of a repeated query_id one beside the other."""
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in found)
    return got == Counter((whole[n][0], *r) for n, rs in expected.items() for r in rs)


def test_exact_search(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(130)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6), (220, [0.5] * 6), (240, [0.5] * 6), (260, [0.5] * 6), (280, [0.0] * 6)]
    rows += [(7, rows[7][1]), (1, [3.0] * 6), (1, [2.0] * 6), (20, [1.5] * 6), (20, rows[20][1]), (300, [2.0, 1.0]), (301, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("cell", F.lit("x")).withColumn("uid", F.lit(0))
    vectors = knn.integer_vectors(df)
    whole, expected = best_of(rows, 5)
    for sizes in ({}, {"n_pivots": 9, "group_queries": 3, "block_rows": 17}, {"n_pivots": 1, "block_rows": 5, "group_queries": 2}):
        assert same_lists(knn.top_k(vectors, F.col("vec_id") % 20 == 0, 5, **sizes).collect(), expected, whole)
    assert len({r.query_id for r in knn.top_k(vectors.where("vec_id in (40, 60)"), F.col("vec_id") % 20 == 0, 5).collect()}) == 2
    assert knn.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_exact_search_of_large_numbers(spark):
    big = float(2**24)
    rows = [(i, [big + i * 2.0, 1.0 + i / 64, -big]) for i in range(40)] + [(40, [2.0**20, 1.0, 2.0**20])]
    vectors = knn.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole, expected = best_of(rows, 7)
    assert max(s for rs in expected.values() for _, _, s in rs) > 2**53
    assert same_lists(knn.top_k(vectors, F.col("vec_id") % 20 == 0, 7, block_rows=9).collect(), expected, whole)
    for x in (2.0**30, 1e300):  # a score, and a component, that no 64-bit integer holds
        far = knn.integer_vectors(spark.createDataFrame([(0, [x]), (1, [x])], "vec_id long, embedding array<double>"))
        with pytest.raises(Exception, match="too large for a 64-bit integer"):
            knn.top_k(far, F.col("vec_id") % 20 == 0).collect()


def test_exact_search_sql(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 50, [float(x) for x in rng.normal(size=4)]) for i in range(120)] + [(20, None), (60, [1.0, float("nan"), 0.0, 0.0]), (61, [None, 1.0, 1.0, 1.0])]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    twin = Counter(con.execute(knn.ORACLE).fetchall())
    vectors = knn.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert twin == Counter((r.query_id, r.rank, r.vec_id, r.score) for r in knn.top_k(vectors, F.col("vec_id") % 20 == 0).collect())


def test_cells_leave_out_what_cannot_matter():
    """Data far from all queries is not replicated."""
    pivots = np.array([[100.0, 0.0], [-100.0, 0.0]])
    data = __import__("pandas").DataFrame({"cell": [0, 1], "near": [[0.0, 1.0, 1.0], [0.0, 1.0, 2.0]]})
    queries = __import__("pandas").DataFrame({"cell": [0], "n": [5], "radius": [1.0], "norm": [101.0]})
    groups, need = knn.plan_groups(pivots, data, queries, 2, 10)
    assert groups == {0: 0} and need[0, 0] <= 1 and need[0, 1] > 50


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in pii.CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(text) if 10 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(4)
    alphabet = list("a.b@-+ ()%19025") + ["555", ".12", "@x.y", "4111 1111 1111 1111", "+1 (202) 555-0100", "10.0.0.256", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_pii_finds_more_in_known_contexts(spark, docs):
    rows = [(i, f"please ring tel: +1 202 555 01{i:02} now or mail me{i}@ex.org today") for i in range(30)]
    rows += [(100, "ring tel: 020 7946 0958 now"), (101, "the number 020 7946 0958"), (102, "serial 99887766 here"), (103, None), (104, ""), (105, "a@b.co " * 3000), (5, "dup +1 202 555 0100"), (5, "dup +1 202 555 0100")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in pii.digest(pii.find(df)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[100][0].spans == "phone:10:23" and got[100][0].n_phone == 0 and got[100][0].n_added == 1
    assert got[101][0].n_added == 1 and got[102][0].spans == ""  # one number, wherever it stands; no context, no span
    assert got[105][0].n_email == 3000 and len(got[5]) == 3 and got[103][0].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[100] == "ring tel: <phone> now" and clean[103] is None and clean[102] == "serial 99887766 here" and "@" not in clean[105]
    clash = spark.createDataFrame([(1, "mail a@b.co", "x", "y", "z")], "doc_id long, text string, _key string, _spans string, spans string")
    assert tuple(pii.redact(clash).first()) == (1, "mail <email>", "x", "y", "z")
    assert len(pii.digest(pii.find(docs)).collect()) == len(TEXTS)
    assert pii.digest(pii.find(df.limit(0))).collect() == [] and pii.redact(docs).columns == docs.columns


def test_toxicity_learns_pairs(spark):
    """Labels that only the pair of two words explains."""
    rng = np.random.default_rng(6)
    fill = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1500):
        words = list(rng.choice(fill, 12))
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ["silly"] * a + ["greenfolk"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(a and b)))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (5001, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    got = toxicity.predictions(docs, spark.createDataFrame([*labels, (9, None), (None, 1)], "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id < 1500]
    assert len(got) == 1503 and 300 < len(held) < 450
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    none = toxicity.predictions(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert all(r.score < 1e-9 and r.predicted == 0 for r in none)
    docs = docs.withColumn("_scored", F.lit("y")).withColumn("predicted", F.lit("z")).withColumn("row", F.lit("w"))
    clean = toxicity.keep_clean(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert clean.select("score", "_scored", "predicted", "row").distinct().collect() == [("x", "y", "z", "w")]
    assert clean.columns == docs.columns and abs(clean.count() - sum(1 for t in truth.values() if not t) - 3) < 40


def test_held_out_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.predictions(docs, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    hit = Counter((r.toxic, r.predicted) for r in rows)
    assert hit[1, 1] / (hit[1, 1] + hit[1, 0]) > 0.8 and hit[0, 1] / (hit[0, 0] + hit[0, 1]) < 0.01


def test_factorization_machine_equals_the_sum_over_pairs():
    """Scores of a batch, and the gradient's direction, against plain sums over all pairs of terms."""
    rng = np.random.default_rng(11)
    slot = np.full(30, -1, np.int32)
    slot[::2] = np.arange(15)
    m = toxicity.Model(-0.3, rng.normal(size=15), rng.normal(size=(15, 4)), slot)
    rows = [np.sort(rng.choice(30, n, replace=False)) for n in (0, 1, 2, 9, 30)]
    for r, got in zip(rows, m.scores(rows), strict=True):
        at = [slot[t] for t in r if slot[t] >= 0]
        z = m.bias + sum(m.weight[i] for i in at) + sum(float(m.factors[i] @ m.factors[j]) for i in at for j in at if i < j)
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-9 and m.score(r) == got
    assert m.scores([]).tolist() == []
    train = [np.sort(rng.choice(30, 8, replace=False)) for _ in range(400)]
    label = np.array([2 in r and 4 in r for r in train])
    kept = np.arange(0, 30, 2)
    fitted = toxicity.fit([r[r % 2 == 0] for r in train], label, kept, 30)
    loss = lambda model: -np.mean(np.log(np.where(label, model.scores(train), 1 - model.scores(train)) + 1e-12))
    flat = toxicity.Model(fitted.bias, fitted.weight, fitted.factors * 0, fitted.slot)
    assert loss(fitted) < 0.05 and loss(fitted) < loss(flat)


def generalised_jaccard(a, b):
    x, y = (Counter({w: n * max(1, len(w)) for w, n in Counter(t.lower().split()).items()}) for t in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_fingerprints(spark, docs, real):
    got = by_id(fingerprint.fingerprints(docs, bucket_rows=3))
    order = sorted(range(len(TEXTS)), reverse=True)
    for n, i in enumerate(order):
        own, following = TEXTS[i] or "", TEXTS[order[(n + 1) % len(order)]] or ""
        changed = fingerprint.edited(own, following)
        assert got[i].n_chars == len(own) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
    assert got[4].fingerprint == got[5].fingerprint and got[0].fingerprint == got[1].fingerprint and got[10].fingerprint != got[1].fingerprint
    texts = {r.doc_id: r.text for r in real.collect()}
    order = sorted(texts, reverse=True)
    rows = by_id(fingerprint.fingerprints(real, n_samples=256, bucket_rows=17))
    gaps = []
    for n, i in enumerate(order):
        following = texts[order[(n + 1) % len(order)]]
        changed = fingerprint.edited(texts[i], following)
        assert rows[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        gaps.append(rows[i].near_edited - generalised_jaccard(texts[i], changed))
    assert abs(np.mean(gaps)) < 0.01 and np.std(gaps) < 0.045  # as 256 samples of a proportion
    same = spark.createDataFrame([(3, "a b"), (3, "a b"), (3, "c"), (None, "z")], "doc_id long, text string")
    assert len(fingerprint.fingerprints(same).collect()) == 4 and fingerprint.fingerprints(same.limit(0)).collect() == []
    alone = fingerprint.fingerprints(same.limit(1)).first()
    assert alone.near_next == 1.0


def passage(n, words=60):
    return " ".join(f"p{n}x{i}" for i in range(words))


def test_line_dedup(spark, docs):
    rows = [
        (1, f"intro a\n{passage(1)}\n{passage(2, 5)}\nend"), (2, f"other start\n{passage(1)}\n{passage(2, 5)}\nown tail of two"), (3, passage(1)), (4, f"short line\n{passage(3, 6)}"), (5, f"short line\n{passage(3, 6)}"),
        (6, f"{passage(4, 13)}\n{passage(5, 13)}"), (7, f"lead\n{passage(4, 13)}\n{passage(5, 13)}\nlast"), (8, f"  {passage(1).replace(' ', '   ')}  \nx"), (9, None), (10, ""), (11, f"b\n{passage(6)}"), (11, f"b\n{passage(6)}"), (None, passage(1)),
    ]
    clash = "doc_id long, text string, gone string, _key string, _gone string, row string, n_lines string, `a.b` string"
    df = spark.createDataFrame([(*r, *"kkkkkk") for r in rows], clash)
    got = {}
    for r in line_dedup.dedup(df).collect():
        got.setdefault(r.row.doc_id, []).append(r)
    assert all(tuple(r.row)[2:] == tuple("kkkkkk") for rs in got.values() for r in rs) and line_dedup.left_over(line_dedup.dedup(df)).columns == df.columns
    text = {i: rs[0].row.text for i, rs in got.items()}
    assert text[1] == rows[0][1] and text[2] == "other start\nown tail of two" and text[3] == ""
    assert text[5] == rows[4][1] and text[6] == rows[5][1] and text[7] == "lead\nlast" and text[8] == "x" and text[9] is None and text[10] == ""
    assert [r.n_deleted for r in got[11]] == [0, 0] and text[None] == passage(1)
    assert len(line_dedup.digest(line_dedup.dedup(docs)).collect()) == len(TEXTS)
    assert line_dedup.dedup(df.limit(0)).collect() == []


def test_patience_alignment():
    assert line_dedup.align([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1, 2)]
    assert line_dedup.align([1, 2, 3], [3, 2, 1]) in ([(0, 2, 1)], [(1, 1, 1)], [(2, 0, 1)])
    assert line_dedup.align([5, 5, 1, 5], [5, 5, 1, 7]) == [(0, 0, 3)]
    assert line_dedup.align([1, 7, 2, 7, 3], [1, 8, 7, 2, 9, 3]) == [(0, 0, 1), (1, 2, 2), (4, 5, 1)]
    assert line_dedup.align([0, 0], [0, 0]) == [] and line_dedup.align([], [1]) == []
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (rng.integers(1, 12, rng.integers(0, 15)).tolist() for _ in range(2))
        end_a = end_b = 0
        for i, j, n in line_dedup.align(a, b):
            assert i >= end_a and j >= end_b and n > 0 and a[i : i + n] == b[j : j + n]
            end_a, end_b = i + n, j + n


def test_dedup_deletes_only_what_stands_earlier(spark, real):
    texts = {r.doc_id: r.text for r in real.collect()}
    first: dict = {}
    for i in sorted(texts):
        for line in texts[i].split("\n"):
            first.setdefault(" ".join(line.split()), i)
    for n_deleted, r in ((r.n_deleted, r.row) for r in line_dedup.dedup(real).collect()):
        gone = Counter(texts[r.doc_id].split("\n")) - Counter(r.text.split("\n"))
        assert all(first[" ".join(x.split())] < r.doc_id for x in gone if x.strip())
        if not n_deleted:
            assert r.text == texts[r.doc_id]
        for line in r.text.split("\n"):
            assert len(line.split()) < 50 or first[" ".join(line.split())] >= r.doc_id


@pytest.mark.parametrize("name", ["op2_license_scan", "op4_exact_topk"])
def test_sql(spark, name):
    from ladderflow.llm.queries import ORACLE, QUERIES

    assert parity.differences(spark, parity.duck(SF), QUERIES[name], ORACLE[name], SF) == ""
