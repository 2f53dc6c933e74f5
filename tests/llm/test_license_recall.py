"""Licence texts as they stand in files: headers, comments, edits; and texts without a licence."""

import re

import duckdb
import numpy as np

from ladderflow.llm import license_scan as L


def labels(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in L.digest(L.scan(df)).collect()}


def test_titles_and_identifiers(spark):
    cases = {
        "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007": "gpl-3", "// SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3", "# SPDX-License-Identifier: MIT": "mit", "LGPL-2.1-only": "lgpl",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1": "lgpl", "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0.": "mpl,mpl-2", "the public library on apache street": "", "a \u212aernel: wor\u212a is wor\u212a": "",
    }
    got = labels(spark, list(cases))
    assert [got[i].labels for i in range(len(cases))] == list(cases.values())


def test_recall_of_planted_headers(spark):
    """Whole sentences as comments, other letters' case, every twelfth word outside the key changed."""
    rng = np.random.default_rng(1)
    texts, expected = [], []
    for t in L.TEMPLATES:
        for n in range(4):
            words = [w if t.key[0] <= i < t.key[1] or rng.random() > 1 / 12 else "zzz" for i, w in enumerate(t.words)]
            words = [w.upper() if n % 2 else w.title() for w in words]
            fill = [f"w{x}" for x in rng.integers(0, 999, rng.integers(0, 40))]
            lines = [" ".join((fill + words + fill)[k : k + 9]) for k in range(0, len(words) + 2 * len(fill), 9)]
            texts.append("\n".join((" * ", "# ", "// ", "")[n] + x for x in lines))
            expected.append(t.label)
    got = labels(spark, texts)
    hit = [e in got[i].labels.split(",") for i, e in enumerate(expected)]
    assert np.mean(hit) == 1.0
    clean = labels(spark, [" ".join(rng.permutation(re.findall(r"\w+", x))) for x in texts if len(x.split()) > 60])
    assert np.mean([r.labels == "" for r in clean.values()]) > 0.9


def test_sql_on_hard_texts(spark):
    rng = np.random.default_rng(2)
    pool = [w for t in L.TEMPLATES[:30] for w in (" ".join(t.words), *t.words[:3])] + ["cc by", "\u212a", "x", "\x00"]
    texts = [" ".join(rng.choice(pool, rng.integers(0, 30))) for _ in range(80)] + ["", None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    twin = {r[0]: r for r in con.execute(L.oracle()).fetchall()}
    got = labels(spark, texts)
    assert {i: tuple(r) for i, r in got.items()} == twin
