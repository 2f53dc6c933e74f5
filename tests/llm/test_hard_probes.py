"""Probes of single operators: pairs of terms that say nothing alone, numbers behind words that end in a digit, texts of a
megabyte, chains of contexts."""

import time

import numpy as np
import pytest

from ladderflow.llm import pii, toxicity


def xor_texts(n, seed, rate=0.5):
    """Toxic if exactly one of two words is there; filler words say nothing."""
    rng = np.random.default_rng(seed)
    a, b = rng.random(n) < rate, rng.random(n) < rate
    texts = [" ".join([*(["alpha"] if x else []), *(["omega"] if y else []), *(f"q{k}" for k in rng.integers(0, 300, 6))]) for x, y in zip(a, b, strict=True)]
    return texts, (a ^ b).astype(int)


def test_a_pair_of_terms_that_say_nothing_alone_is_learned(spark):
    texts, y = xor_texts(5_000, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    rows = [r for r in toxicity.predictions(docs, labels).collect() if r.held_out]
    assert len(rows) > 1_000 and np.mean([r.predicted == y[r.doc_id] for r in rows]) > 0.97


def test_pairs_are_chosen_by_their_contrast():
    rng = np.random.default_rng(2)
    x = rng.random((3_000, 12)) < 0.4
    y = x[:, 3] ^ x[:, 7]
    rows = [np.flatnonzero(r).astype(np.int32) * 2 for r in x]
    seen, seen1 = (np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t or k == 0]), minlength=24) for k in (0, 1))
    assert not {6, 14} & set(toxicity.choose(seen, seen1, 3_000, int(y.sum())).tolist()) or abs(np.corrcoef(x[:, 3], y)[0, 1]) > 0.03
    for block in (1, 5, 512):
        assert toxicity.choose_pairs(rows, y, np.arange(0, 24, 2), 24, block=block).tolist() == [6, 14]
    added = x[:, 3].astype(int) + x[:, 7] >= 1  # either of them: the contrast is there as well
    assert toxicity.choose_pairs(rows, added, np.arange(0, 24, 2), 24).tolist() == [6, 14]
    assert toxicity.choose_pairs(rows, rng.random(3_000) < 0.3, np.arange(0, 24, 2), 24).tolist() == []
    assert toxicity.choose_pairs(rows, y, np.arange(0), 24).tolist() == []


def test_gradient_steps_equal_plain_ones():
    """The first steps of the fit against loops over rows and pairs: plain Adam of the log loss."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(r).astype(np.int32) for r in rng.random((40, 6)) < 0.5]
    y = rng.random(40) < 0.4
    model = toxicity.fit(rows, y, np.arange(6), 6, n_factors=2, epochs=3, rate=0.05, l2=0.01, seed=5)
    g = np.random.default_rng(5)
    w, v, b = np.zeros(6), g.normal(0, 0.02, (6, 2)), float(np.log(y.sum() / (40 - y.sum())))
    mw, sw, mv, sv = np.zeros(6), np.zeros(6), np.zeros((6, 2)), np.zeros((6, 2))
    for step in range(1, 4):
        g.permutation(40)
        gw, gv, gb = np.zeros(6), np.zeros((6, 2)), 0.0
        for r, t in zip(rows, y, strict=True):
            z = b + sum(w[i] for i in r) + sum(v[i] @ v[j] for i in r for j in r if i < j)
            e = 1 / (1 + np.exp(-z)) - t
            gb += e / 40
            for i in r:
                gw[i] += e / 40
                gv[i] += e * sum((v[j] for j in r if j != i), np.zeros(2)) / 40
        gw, gv = gw + 0.01 * w, gv + 0.01 * v
        for value, grad, m, s in ((w, gw, mw, sw), (v, gv, mv, sv)):
            m += 0.1 * (grad - m)
            s += 0.001 * (grad * grad - s)
            value -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        b -= 0.05 * gb
    assert model.weight == pytest.approx(w) and model.factors == pytest.approx(v) and model.bias == pytest.approx(b)


def found(text):
    return [(text[s:e], kinds) for s, e, kinds in pii.candidates(text, pii.base_spans(text))]


def test_words_beside_a_number_do_not_swallow_it():
    assert found("call hop0 1000000 on sa end") == [("1000000", 8)]
    assert found("gate2 020 7946 0958") == [("020 7946 0958", 8)]
    assert found("room 020 7946 0958 4th floor") == [("020 7946 0958", 8)]
    assert found("code AB1234 5551234x") == [("AB1234", 0), ("5551234x", 0)]
    assert found("AB12-3456CD") == [("AB12-3456CD", 0)] and found("a1 22 b") == []
    assert found("x@local and y (at) ex (dot) org, z@") == [("x@local", 1), ("y (at) ex (dot) org", 1)]


@pytest.mark.parametrize("unit", ["1", "a", "1.", "1 ", "a@", "+1(", "abc1234", "x1 ", "(at)", "a [at] ", "1-", "Ü1"])
def test_time_is_linear_in_a_text(unit):
    """A run of a megabyte takes seconds at most; quadratic search would take hours."""
    text = unit * (1_000_000 // len(unit)) + " me@ex.org [at] x"
    began = time.perf_counter()
    pii.candidates(text, pii.base_spans(text))
    assert time.perf_counter() - began < 15


def test_a_chain_of_contexts_is_followed_to_its_end(spark):
    """Seven contexts, each known only by numbers that the one before shares: more rounds than any fixed small number."""
    number = lambda hop, i: f"{1_000_000 + hop * 1_000 + i}"
    texts = [f"tel hopa +1 202 555 {i:04} x{i % 3} end" for i in range(40)] + [f"tel hopa {number(0, i)} y{i % 3} end" for i in range(12)]
    for hop in range(1, 8):
        word = "hop" + "abcdefghij"[hop] + str(hop)  # ends in a digit
        texts += [f"w{i % 3} {word} {number(hop - 1, i)} z{i % 3} end" for i in range(12)] + [f"w{i % 3} {word} {number(hop, i)} z{i % 3} end" for i in range(12)]
    rows = pii.digest(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    got = {r.doc_id: r.spans for r in rows}
    assert all(got[i].startswith("phone:") for i in range(len(texts)))
