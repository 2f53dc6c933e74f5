"""Interaction of filters: what each of five filters removes in every order, by part of the corpus.

Every document gets a mask of the filters that it fails; all else is sums over masks. Duplicates are found by sorting: rows
are dealt out by ranges of (fingerprint, doc_id), sorted by fingerprint, whole text and doc_id, and compared with their
predecessor. A group of copies of any size is cut over as many tasks as its share needs, because doc_id is part of the
range. What a range cannot see is the range before it: each task also returns the texts of its last fingerprint with their
smallest doc_id, and the rows of its first fingerprint that stand open are settled by those of other ranges (few rows for
each range). Masks are then counted by part with partial sums, at most 32 rows for each part and task.

Filters: A few words, B repeated words, C upper case, D marks, E a copy of a document with a smaller doc_id.

Defined results: a null text counts as empty (it fails A; all empty ones are copies of each other). A row without doc_id is a
copy of none and has no copies. Rows that repeat a doc_id each count; of rows with the same text those of the smallest doc_id
pass E, all of them. Labels: a document is good or toxic if any row of labels for its doc_id says so; without a label neither.
A null lang is the empty string. An empty table gives no rows; extra columns are ignored; texts of any length are compared
whole.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderflow.llm.common import materialize, small, texts

#: Names of the filters; a failed one sets the bit of its place.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MARKS = "doc_id long, part string, mask int, fp long, digest binary, tail boolean"


def text_mask(text: Column, words: Column) -> Column:
    """The filters A to D that a text with these words fails."""
    n, chars = F.size(words), F.length(text)
    upper = chars - F.length(F.translate(text, UPPER, ""))
    failed = (n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * upper > 10 * chars, text.rlike(r"[#$%&*|]"))
    mask = F.lit(0)
    for i, one in enumerate(failed):
        mask = mask + F.when(one, 1 << i).otherwise(0)
    return mask


def _mark(batches):
    """Rows in order of (fp, text, doc_id) -> marked rows; copies get their bit, rows that only another range can settle get
    a digest of their text, and the texts of the last fingerprint follow as tail rows."""
    first_fp = last = None  # last: (fp, text, smallest doc_id of the run) of the row before
    tails: dict[bytes, int] = {}
    tail_fp = None
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        ids, fp, text, mask = b.column("doc_id"), b.column("fp").to_numpy(), b.column("text"), b.column("mask").to_numpy()
        first_fp = int(fp[0]) if first_fp is None else first_fp
        begins = np.ones(n, bool)
        begins[1:] = (fp[1:] != fp[:-1]) | ~pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        begins[0] = last is None or last[0] != fp[0] or last[1] != text[0].as_py()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        number = ids.fill_null(0).to_numpy()
        starts = np.flatnonzero(begins)
        run = np.cumsum(begins) - 1  # -1: the run of the batch before
        lowest = np.append(number[starts], last[2] if last and last[2] is not None else 0)[run]
        none = np.append(null[starts], bool(last) and last[2] is None)[run]  # a run without any doc_id
        copy = ~null & ~none & (number > lowest)
        open_rows = np.flatnonzero((fp == first_fp) & ~null & ~copy)
        digests: list[bytes | None] = [None] * n
        for i in open_rows.tolist():
            digests[i] = digest(text[i].as_py())
        yield pa.RecordBatch.from_arrays(
            [ids, b.column("part"), pa.array((mask | np.where(copy, COPY, 0)).astype(np.int32)), b.column("fp"), pa.array(digests, pa.binary()), pa.array(np.zeros(n, bool))],
            names=["doc_id", "part", "mask", "fp", "digest", "tail"],
        )
        if tail_fp != int(fp[-1]):
            tails, tail_fp = {}, int(fp[-1])
        for i in starts[fp[starts] == tail_fp].tolist():
            if not null[i]:
                tails[digest(text[i].as_py())] = int(number[i])
        low = None if none[-1] else int(lowest[-1])
        last = (int(fp[-1]), text[n - 1].as_py(), low)
    k = len(tails)
    none_of = lambda kind: pa.nulls(k, kind)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(tails.values()), pa.int64()), none_of(pa.string()), none_of(pa.int32()), pa.array([tail_fp] * k, pa.int64()), pa.array(list(tails), pa.binary()), pa.array([True] * k, pa.bool_())],
        names=["doc_id", "part", "mask", "fp", "digest", "tail"],
    )


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of every document."""
    rows = texts(docs, F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    # the row's number cuts a group that repeats one doc_id; masks are made behind the shuffle, as the ranges are sampled first
    ranged = rows.withColumn("fp", F.xxhash64("text")).repartitionByRange("fp", "doc_id", F.monotonically_increasing_id())
    in_order = ranged.sortWithinPartitions("fp", "text", F.asc_nulls_last("doc_id"))
    worded = in_order.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    masked = worded.select("doc_id", "part", "fp", "text", text_mask(F.col("text"), F.col("words")).alias("mask"))
    marks = materialize(masked.mapInArrow(_mark, MARKS), "audit-marks")
    tails = materialize(marks.where("tail").groupBy("fp", "digest").agg(F.min("doc_id").alias("lowest")), "audit-tails")
    own = marks.where(~F.col("tail"))
    settled = own.where("digest IS NOT NULL").join(small(tails), ["fp", "digest"], "left")
    copy = F.when(F.col("doc_id") > F.col("lowest"), F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask"))
    return own.where("digest IS NULL").select("doc_id", "part", "mask").union(settled.select("doc_id", "part", copy.alias("mask")))


def mask_counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: additive counters of documents. Equal rows are counted before they meet the labels, so a
    doc_id that many rows share is a few rows there."""
    says = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("bigint")), F.lit(0).cast("bigint")).alias(c)
    known = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(says("quality"), says("toxic"))
    counted = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    total = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0).cast("bigint"))
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley; see the module."""
    counters = mask_counters(failure_masks(docs), labels)
    letters = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")
    grid = counters.select("*", F.explode(letters).alias("filter_order")).select("*", steps)
    place = F.transform(F.split("filter_order", ""), lambda c: F.pow(F.lit(2), F.ascii(c) - ord(FILTERS[0])).cast("int"))
    grid = grid.withColumn("bits", place)
    own = F.get("bits", F.col("step") - 1)
    before = F.aggregate(F.slice("bits", 1, F.col("step") - 1), F.lit(0), lambda s, x: s + x)
    grid = grid.select("part", "mask", "n", "good", "toxic", "filter_order", "step", own.alias("own"), before.alias("earlier"))
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("earlier")) != 0
    every = 1
    for i in range(2, len(FILTERS) + 1):
        every *= i
    # over all orders, a document that fails k filters is removed by each of them equally often
    share = F.when(fails, F.col("n") * F.expr(f"{every} DIV bit_count(mask)")).otherwise(0)
    total = lambda keep, c="n": F.sum(F.when(keep, F.col(c)).otherwise(0)).cast("bigint")
    return grid.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"), F.sum(share).cast("bigint").alias("shapley"),
    )


#: DuckDB SQL for the registered query: every order is run over every mask, and the shares are summed over the orders.
ORACLE = r"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS lowest FROM t),
f AS (SELECT doc_id, part, CAST(len(words) < 100 AS INT) AS a, CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT) AS b,
 CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INT) AS c, CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS d, CAST(coalesce(doc_id > lowest, false) AS INT) AS e FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x(i) AS (VALUES (1), (2), (3), (4), (5)),
o AS (SELECT [p.i, q.i, r.i, s.i, t.i] AS places FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
g AS (SELECT part, array_to_string(list_transform(places, lambda v: chr(CAST(64 + v AS INT))), '') AS filter_order, CAST(step.i AS INT) AS step, places[step.i] AS own, fails, n, good, toxic,
 fails[places[step.i]] = 1 AS failed, len(list_filter(places[1 : step.i - 1], lambda v: fails[v] = 1)) > 0 AS gone FROM m, o, x step),
s AS (SELECT part, filter_order, step, any_value(own) AS own, sum(CASE WHEN NOT failed AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN failed AND NOT gone THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN failed AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed AND list_sum(fails) = 1 THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN failed AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN failed AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM g GROUP BY 1, 2, 3)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM s"""
