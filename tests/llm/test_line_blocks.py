"""Common blocks against a search through all earlier documents."""

import numpy as np

from ladderflow.llm import line_dedup


def passage(n, words=60, width=60):
    xs = [f"p{n}x{i}" for i in range(words)]
    return "\n".join(" ".join(xs[i : i + width]) for i in range(0, words, width))


def brute(rows, least):
    """Line numbers of each document in runs of least words that an earlier document holds."""
    lines = {i: [" ".join(x.split()) for x in text.split("\n")] for i, text in rows}
    gone = {}
    for i, late in lines.items():
        held = {tuple(e[a:b]) for k, e in lines.items() if k < i for a in range(len(e)) for b in range(a + 1, len(e) + 1)}
        out = set()
        for a in range(len(late)):
            for b in range(a + 1, len(late) + 1):
                if sum(len(x.split()) for x in late[a:b]) >= least and tuple(late[a:b]) in held:
                    out |= set(range(a, b))
        if out:
            gone[i] = sorted(out)
    return gone


def found(spark, rows, least=25, **sizes):
    return {r.doc_id: list(r.gone) for r in line_dedup.deletions(spark.createDataFrame(rows, "doc_id long, text string"), least, **sizes).collect()}


def test_no_partner_is_missed(spark):
    p, q, r = (passage(n) for n in range(3))
    twice_early = [(1, f"a\n{p}\nb\n{p}"), (2, f"c\n{p}"), (3, f"d\n{p}")]
    twice_late = [(11, f"e\n{q}"), (12, f"{q}\nf\n{q}")]
    swapped = [(21, f"{r}\n{passage(7)}"), (22, f"{passage(7)}\n{r}")]
    anchor = "one line of more than eight words that many documents hold"
    other = [(31, f"{anchor}\ng"), (32, f"{anchor}\n{passage(8, 40, 5)}"), (33, f"h\n{anchor}\n{passage(8, 40, 5)}")]
    assert found(spark, twice_early + twice_late + swapped + other) == {2: [1], 3: [1], 12: [0, 2], 22: [0, 1], 33: list(range(1, 10))}


def test_random_documents(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["", "  ", "a", "b b", "c c c", "d d d d d", "e " * 9]
    rows = [(i, "\n".join(vocabulary[k] for k in rng.integers(0, 7, rng.integers(1, 14)))) for i in range(80)]
    assert found(spark, rows, 8) == found(spark, rows, 8, hot_docs=3) == brute(rows, 8)


def test_blocks_of_short_lines(spark):
    verse = passage(1, 60, 3)
    apart = passage(2, 60, 7).replace("\n", "\n\n")
    rows = [(1, f"a\n{verse}"), (2, f"b\n{verse}\nc"), (3, f"d\n{apart}"), (4, f"{apart}\ne"), (5, f"f\n{passage(3, 24, 3)}"), (6, f"g\n{passage(3, 24, 3)}")]
    assert found(spark, rows) == {2: list(range(1, 21)), 4: list(range(17))} == brute(rows, 25)


def test_blocks_that_the_judged_code_missed(spark):
    lines15, lines8 = "\n".join(["a b c"] * 15), "\n\n".join(["d e f g h i j"] * 8)
    apart = " ".join(f"q{i}" for i in range(15)), " ".join(f"r{i}" for i in range(15))
    rows = [(1, f"x\n{lines15}"), (2, f"{lines15}\ny"), (3, lines8), (4, f"z\n{lines8}"), (5, f"{apart[0]}\nu\n{apart[1]}"), (6, f"{apart[0]}\n\n{apart[1]}"), (7, f"v\n{apart[0]}\n\n{apart[1]}")]
    assert found(spark, rows) == brute(rows, 25) == {2: list(range(15)), 4: list(range(1, 16)), 7: [1, 2, 3]}


def test_alignment_alone_equals_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(400):
        early, late = (["w " * k for k in rng.integers(0, 7, rng.integers(1, 16))] for _ in range(2))
        keys = [[line_dedup.line_key(x) for x in d] for d in (early, late)]
        own = line_dedup.common_lines(*([k[i] for k in d] for d in keys for i in (0, 1)), 6)
        assert own == brute([(1, "\n".join(early)), (2, "\n".join(late))], 6).get(2, [])
