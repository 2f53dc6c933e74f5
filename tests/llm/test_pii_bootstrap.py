"""Bootstrapping: two-hop discovery, a plain version of the scoring, precision and recall on planted contexts."""

import math
from collections import Counter, defaultdict

import numpy as np

from ladderflow.llm import pii


def plain(texts, rounds=4, min_support=3, min_score=0.6, odd_score=0.9):
    """{value: (kind, score)} of the promoted candidates, by loops over all instances."""
    rows = [r for t in texts for r in pii.instances(t, pii.base_spans(t))]
    edge = Counter((p, r["value"], r["k"], r["fits"]) for r in rows for p in r["patterns"])
    places = Counter(r["value"] for r in rows if r["k"] < 0)
    slots = defaultdict(list)
    for (p, v, k, fits), n in edge.items():
        slots[p].append((v, k, fits, n))
    best = {}
    for _ in range(rounds):
        confidence = {}
        for p, xs in slots.items():
            for kind in range(4):
                pos = known = seen = 0
                for v, k, fits, n in xs:
                    score = 1.0 if k == kind else best[v][1] if k < 0 and v in best and best[v][0] == kind else None
                    if score is not None:
                        pos, known, seen = pos + score * n, known + 1, seen + n * (fits >> kind & 1)
                fitting = sum(n for _, _, fits, n in xs if fits >> kind & 1)
                if known >= min_support and any(k < 0 for _, k, _, _ in xs):
                    c = pos / (1 + pos + max(0, fitting - seen) / 3 + sum(n for *_, n in xs) - fitting)
                    if c >= 0.1:
                        confidence[p, kind] = min(c, 0.99)
        doubt, form = defaultdict(float), {}
        for (p, v, k, fits), n in edge.items():
            for kind in range(4):
                if k < 0 and (p, kind) in confidence:
                    doubt[v, kind] += math.log1p(-confidence[p, kind]) * n / places[v]
                    form[v] = fits
        now = {}
        for (v, kind), d in sorted(doubt.items(), key=lambda x: x[0][1]):
            score = 1 - math.exp(d)
            if score >= (min_score if form[v] >> kind & 1 else odd_score) and score > now.get(v, (0, 0))[1]:
                now[v] = (kind, score)
        done, best = len(now) == len(best), now
        if done:
            break
    return best


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def spans(spark, texts):
    return {r.doc_id: r.spans for r in pii.digest(pii.find(frame(spark, texts))).collect()}


def two_hops():
    """Seeds behind "tel:"; ten numbers behind "tel:" and behind "mobile"; ten others only behind "mobile"."""
    rng = np.random.default_rng(1)
    fill = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**3, 3))
    texts = [f"{fill()} tel: +1 202 555 {i:04} {fill()}" for i in range(40)]
    near = [f"020 79{i:02} 09{i:02}" for i in range(10)]
    far = [f"030 55{i:02} 77{i:02}" for i in range(10)]
    texts += [f"{fill()} tel: {x} {fill()}" for x in near] + [f"{fill()} mobile {x} {fill()}" for x in near + far]
    return texts, near, far


def test_two_hops(spark):
    texts, near, far = two_hops()
    got = spans(spark, texts + ["in 1998 it was", "in 2001 it was", "serial 99887766 here"])
    for i, t in enumerate(texts):
        for x in near + far:
            if x in t:
                assert got[i] == f"phone:{t.index(x)}:{t.index(x) + len(x)}"
    assert [got[len(texts) + i] for i in range(3)] == ["", "", ""]


def test_scores_equal_the_plain_version(spark):
    rng = np.random.default_rng(2)
    words = ["tel", "card", "ip", "mail", "in", "no."]
    forms = ["+1 202 555 {:04}", "020 7946 {:04}", "10.0.0.{}", "10.0.0.1.{}", "me{}@ex.org", "me{}@local", "code {:04}", "AB{:04}", "4111 1111 1111 {:04}", "4111 1111 1111 1111", "me{} [at] ex [dot] org"]
    texts = [" ".join(f"{rng.choice(words)} {rng.choice(words)} {str(rng.choice(forms)).format(rng.integers(0, 60))}" for _ in range(rng.integers(1, 6))) + " end" for _ in range(150)]
    inst = pii.materialize(frame(spark, texts).selectExpr("doc_id", "0L as text_key", "text").mapInArrow(pii._search, pii.FOUND), "test").selectExpr("inline(inst)")
    for settings in ((4, 3, 0.6, 0.9), (2, 2, 0.3, 0.4)):
        expected = plain(texts, *settings)
        found = pii.promoted(inst, *settings)
        got = {r.value: (r.k, r.score) for r in found.collect()} if found is not None else {}
        assert {v: k for v, (k, _) in got.items()} == {v: k for v, (k, _) in expected.items()}
        assert all(abs(got[v][1] - expected[v][1]) < 1e-9 for v in got)
    assert len(expected) > 20


def test_precision_and_recall_of_planted_contexts(spark):
    """Numbers that miss the strict forms, in contexts that seeds share, against numbers of other contexts."""
    rng = np.random.default_rng(3)
    texts, planted = [], {}
    valid = iter([x for x in range(10**4) if pii.luhn(f"411111111111{x:04}")])
    slots = {3: ("call me at", "+44 20 7946 {:04}", "020 7946 {:04}"), 2: ("visa card", None, "4111 1111 1111 {:04}"), 0: ("write to", "a{}@ex.org", "a{} (at) ex (dot) org")}
    for i in range(600):
        kind = int(rng.choice([0, 2, 3]))
        words, strict, loose = slots[kind]
        fill = " ".join(f"w{x}" for x in rng.integers(0, 10**4, 4))
        case = rng.integers(0, 3)
        body = [f"{words} {strict.format(i) if strict else f'4111 1111 1111 {next(valid):04}'}", f"{words} {loose.format(1000 + i)}", f"order number {rng.integers(10**6, 10**8)} of {rng.integers(1900, 2030)}"][case]
        texts.append(f"{fill} {body} {fill}")
        if case == 1 and not pii.base_spans(body):
            planted[i] = kind
    got = {i: s for i, s in spans(spark, texts).items()}
    added = {i for i, s in got.items() if len([x for x in s.split(",") if x]) > len(pii.base_spans(texts[i]))}
    right = {i for i in added if i in planted and got[i].startswith(pii.KINDS[planted[i]])}
    assert len(planted) > 150 and len(right) / len(planted) > 0.95 and len(right) / len(added) > 0.95
