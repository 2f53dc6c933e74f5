"""License scan [native]: a positional index of rare licence words.

Templates are sentences of licences and their notices, titles and SPDX identifiers, each with a mandatory key phrase. A
word's IDF is taken over the templates. The index lists, for the words of highest IDF, their postings: templates and places
in them. A file is scanned once for indexed words; each posting of such a word gives the place where its template would
start. The template's second rare word must have a posting at the same relative place (intersection), then the key phrase is
verified word by word, then the coverage is the IDF-weighted share of template words that stand where they should. The
work grows with a file's indexed words and their postings, not with the number of templates. Everything is an array
expression on one row: no Python, no shuffle, no join.

Key phrases hold both rare words, so no template whose key stands in the text is missed.

Defined results: null and empty texts have no words, no labels and score 0. Repeated rows give repeated results. Several
templates at one place all count (ties need no order: labels are distinct and sorted, the score is the largest). Extra columns
of the input are ignored, a null doc_id is kept. Very long texts are taken whole. Empty tables give no rows.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators of words, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Frequent words of English: never rare words of a template that has others.
COMMON = frozenset("a all an and any are as at be by copy either for free from in is it may not of on or other out see shall that the this to under use version which with without you".split())


@dataclass(frozen=True)
class Template:
    """words: the sentence; key: (from, to) of the words that must all stand; base: a label the contract fixes."""

    label: str
    words: tuple[str, ...]
    key: tuple[int, int]
    base: bool = False


def _t(label: str, sentence: str, key: str | None = None, base: bool = False) -> Template:
    words = tuple(w for w in re.split(SEPARATORS, sentence.lower()) if w)
    inner = tuple(w for w in re.split(SEPARATORS, (key or sentence).lower()) if w)
    at = next(i for i in range(len(words)) if words[i : i + len(inner)] == inner)
    return Template(label, words, (at, at + len(inner)), base)


#: SPDX identifiers of well-known licences and their labels.
SPDX = {
    "MIT": "mit", "Apache-2.0": "apache-2", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd", "0BSD": "bsd", "ISC": "isc", "Zlib": "zlib", "BSL-1.0": "boost", "Unlicense": "unlicense", "WTFPL": "wtfpl",
    "GPL-2.0": "gpl-2", "GPL-3.0": "gpl-3", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl", "MPL-2.0": "mpl-2", "EPL-1.0": "epl", "EPL-2.0": "epl", "CC0-1.0": "cc0", "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-NC-4.0": "cc-by-nc", "PSF-2.0": "python", "Artistic-2.0": "artistic",
}
#: Sentences of well-known licences and notices; the first three with the labels that the contract fixes.
TEMPLATES: tuple[Template, ...] = (
    _t("mit", "under the mit license", base=True),
    _t("apache-2", "apache license version 2", base=True),
    _t("cc-by-nc", "cc by nc", base=True),
    _t("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "Permission is hereby granted, free of charge"),
    _t("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "copyright notice and this permission notice shall be included"),
    _t("mit", "The MIT License (MIT)", "MIT License"),
    _t("mit", "released under the terms of the MIT license", "terms of the MIT license"),
    _t("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "Apache License, Version 2.0"),
    _t("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", "required by applicable law or agreed to in writing"),
    _t("apache-2", "Apache 2.0 license", "Apache 2.0"),
    _t("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistribution and use in source and binary forms"),
    _t("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions of source code must retain"),
    _t("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation", "Redistributions in binary form must reproduce"),
    _t("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived"),
    _t("bsd", "under the BSD license", "BSD license"),
    _t("bsd", "governed by a BSD style license", "BSD style license"),
    _t("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    _t("isc", "under the ISC license", "ISC license"),
    _t("gpl-3", "GNU General Public License version 3"),
    _t("gpl-2", "GNU General Public License version 2"),
    _t("gpl-3", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "GNU General Public License as published by the Free Software Foundation, either version 3"),
    _t("gpl-2", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "GNU General Public License as published by the Free Software Foundation; either version 2"),
    _t("gpl", "under the terms of the GNU General Public License", "GNU General Public License"),
    _t("gpl", "You should have received a copy of the GNU General Public License along with this program", "received a copy of the GNU General Public License"),
    _t("lgpl", "under the terms of the GNU Lesser General Public License", "GNU Lesser General Public License"),
    _t("lgpl", "under the terms of the GNU Library General Public License", "GNU Library General Public License"),
    _t("agpl", "under the terms of the GNU Affero General Public License", "GNU Affero General Public License"),
    _t("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License, v. 2.0"),
    _t("mpl-2", "Mozilla Public License Version 2.0"),
    _t("mpl", "subject to the Mozilla Public License", "Mozilla Public License"),
    _t("epl", "made available under the terms of the Eclipse Public License", "Eclipse Public License"),
    _t("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
    _t("public-domain", "has been placed in the public domain", "in the public domain"),
    _t("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages", "In no event will the authors be held liable"),
    _t("zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software", "must be plainly marked as such"),
    _t("boost", "Distributed under the Boost Software License, Version 1.0", "Boost Software License"),
    _t("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "FUCK YOU WANT TO PUBLIC LICENSE"),
    _t("cc0", "Creative Commons Zero"),
    _t("cc0", "CC0 1.0 Universal", "CC0 1.0"),
    _t("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0"),
    _t("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "Creative Commons Attribution ShareAlike"),
    _t("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "Creative Commons Attribution NonCommercial"),
    _t("cc-by-nd", "licensed under a Creative Commons Attribution NoDerivatives 4.0 International License", "Creative Commons Attribution NoDerivatives"),
    _t("artistic", "under the terms of the Artistic License", "Artistic License"),
    _t("python", "Python Software Foundation License"),
    *(_t(label, f"SPDX License Identifier {name}") for name, label in SPDX.items()),
    *(_t(label, f"{name} or later") for name, label in SPDX.items() if "GPL" in name),
    *(_t(label, f"{name} only") for name, label in SPDX.items() if "GPL" in name),
)


@dataclass(frozen=True)
class Index:
    """idf: of each word of each template; anchors: places of the two rarest words of each key; postings: of each template's
    rarest word, (template, place)."""

    templates: tuple[Template, ...]
    idf: list[list[float]]
    anchors: list[tuple[int, int]]
    postings: dict[str, list[tuple[int, int]]]


def index(templates: tuple[Template, ...] = TEMPLATES) -> Index:
    """The positional index. Frequent words count as rare only where a key has no others; ties go to the longer word, then
    to the earlier one."""
    df: dict[str, int] = {}
    for t in templates:
        for w in set(t.words):
            df[w] = df.get(w, 0) + 1
    out = Index(templates, [], [], {})
    for n, t in enumerate(templates):
        idf = [math.log((1 + len(templates)) / df[w]) for w in t.words]
        order = sorted(range(*t.key), key=lambda i: (t.words[i] in COMMON, -idf[i], -len(t.words[i]), i))
        first, second = order[0], order[min(1, len(order) - 1)]
        out.idf.append(idf)
        out.anchors.append((first, second))
        out.postings.setdefault(t.words[first], []).append((n, first))
    return out


def _words(text: Column) -> Column:
    """Words of the text, A-Z lower-cased. lower() is faster than translate() and differs in what matters here, words of
    ASCII letters, only by the Kelvin sign, which it makes a k."""
    lowered = F.when(text.contains("\u212a"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


MATCH = "array<struct<label:string,base:boolean,start:int,end:int,coverage:double>>"


def scan(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, min_coverage: float = 0.5) -> DataFrame:
    """doc_id, n_words, matches array<struct<label, base, start, end, coverage>> (start in words, from 0)."""
    made = index(templates)
    rare = sorted(made.postings)
    # literal tables: the postings of each indexed word, and the templates, found by number
    constant = lambda rows, schema: F.from_json(F.lit(json.dumps(rows)), schema)
    indexed = constant(rare, "array<string>")
    postings = constant([[{"t": n, "at": at} for n, at in made.postings[w]] for w in rare], "array<array<struct<t:int,at:int>>>")
    known = constant(
        [
            {"label": t.label, "base": t.base, "words": t.words, "idf": idf, "total": sum(idf), "low": t.key[0], "high": t.key[1], "second": second}
            for t, idf, (_, second) in zip(templates, made.idf, made.anchors, strict=True)
        ],
        "array<struct<label:string,base:boolean,words:array<string>,idf:array<double>,total:double,low:int,high:int,second:int>>",
    )
    words = df.select("doc_id", _words(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    hits = words.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), "words",
        F.filter(F.transform("words", lambda w, i: F.when(w.isin(*rare), i)), lambda i: i.isNotNull()).alias("hits"),
    )
    here = lambda i: F.get(F.col("words"), i)

    def starts(i: Column) -> Column:
        of = F.get(postings, (F.array_position(indexed, here(i)) - 1).cast("int"))
        return F.transform(of, lambda p: F.struct(F.get(known, p["t"]).alias("t"), (i - p["at"]).alias("start")))

    def met(c: Column) -> Column:
        t, at = c["t"], c["start"]
        key = F.slice(t["words"], t["low"] + 1, t["high"] - t["low"])
        return (here(at + t["second"]) == F.get(t["words"], t["second"])) & F.when(at + t["low"] >= 0, F.slice(F.col("words"), at + t["low"] + 1, t["high"] - t["low"]) == key).otherwise(False)

    def match(c: Column) -> Column:
        t, at = c["t"], c["start"]
        stands = F.transform(t["words"], lambda w, j: F.when(here(at + j) == w, F.get(t["idf"], j)).otherwise(0.0))
        share = F.aggregate(stands, F.lit(0.0), lambda acc, x: acc + x) / t["total"]
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), at.cast("int").alias("start"), (at + F.size(t["words"])).cast("int").alias("end"), F.least(F.lit(1.0), share).alias("coverage"))

    found = F.transform(F.filter(F.flatten(F.transform("hits", starts)), met), match)
    return hits.select("doc_id", "n_words", F.when(F.size("hits") > 0, F.filter(found, lambda m: m["coverage"] >= min_coverage)).otherwise(F.array().cast(MATCH)).alias("matches"))


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the contract, from scan()."""
    m = F.col("matches")
    base = F.filter(m, lambda x: x["base"])
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    start = F.transform(base, lambda x: x["start"].cast("long"))
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        joined(base).alias("base_labels"), joined(m).alias("labels"),
        F.coalesce(F.array_max(F.transform(m, lambda x: F.floor(x["coverage"] * 1e6 + 0.5) / 1e6)), F.lit(0.0)).alias("score"),
    )


def oracle(templates: tuple[Template, ...] = TEMPLATES, min_coverage: float = 0.5) -> str:
    """DuckDB SQL for digest(scan(documents)): each template at every place of its key phrase, without the index."""
    q = lambda w: "'" + w + "'"
    rows = ", ".join(
        f"({q(t.label)}, {str(t.base).lower()}, [{', '.join(map(q, t.words))}], [{', '.join(map(repr, idf))}]::DOUBLE[], {t.key[0]}, {t.key[1]}, {sum(idf)!r}::DOUBLE)"
        for t, idf in zip(templates, index(templates).idf, strict=True)
    )
    return f"""
WITH t(label, base, words, idf, low, high, total) AS (VALUES {rows}),
d AS (SELECT doc_id, row_number() OVER () AS rid,
      regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT rid, w, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT p.rid, p.w, t.*, p.i - 1 - t.low AS start FROM p JOIN t ON p.word = t.words[t.low + 1]
      WHERE p.w[p.i : p.i + t.high - t.low - 1] = t.words[t.low + 1 : t.high]),
m AS (SELECT * FROM (SELECT rid, label, base, start, least(1.0, list_sum(list_transform(range(1, len(words) + 1),
      lambda j: CASE WHEN start + j >= 1 AND w[greatest(1, start + j)] = words[j] THEN idf[j] ELSE 0.0 END)) / total) AS coverage FROM k)
      WHERE coverage >= {min_coverage}),
g AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word,
       max(start) FILTER (WHERE base) AS last_word,
       string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
       string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(floor(coverage * 1e6 + 0.5) / 1e6) AS score
       FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0.0) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (rid)"""
