"""Line dedup by pairwise alignment.

A common block is a run of successive lines (blanks folded, blank lines included) of at least ``min_words`` words that
stands, line for line, in two documents. Every line of a common block is deleted from the later document (larger doc_id),
wherever the block stands there or in the earlier one and however often.

1. Lines are hashed. A single line may be in any number of documents; rare are the hashes of runs of lines, so these find
   the documents that overlap: for each line the shortest run of ``min_words`` words that starts with it and the shortest
   that ends with it, two for each line whatever its length. A run that several documents hold gives each of them one
   pair, with its first holder: the pairs grow with the runs, never with the square of a group, and no run is too frequent.
2. Each pair of documents is aligned by patience diff: lines that are unique in both give, by a longest increasing
   subsequence, the fixed points, which grow up and down into common blocks; the gaps between blocks are aligned alike.
3. Blocks of at least ``min_words`` words are deleted from the later document. What is left of it is aligned with the earlier
   document again, which finds blocks in another order. Runs that are not unique in the earlier document, or left over
   for that reason, are fixed points at their first place there.

Nothing is lost: each line of a common block is in a run inside the block (if the block has ``min_words`` words up to the
line, the run that ends with it; else the run that starts with the block's first line, which reaches beyond it). The first
holder of that run is an earlier document, and step 3 ends only when no run of the pair is left. A deleted line always stands
in an earlier document too, so the first copy of everything remains.

Defined results: null text is the empty text and stays null. Documents without doc_id, and rows that repeat a doc_id
with respect to each other, are neither earlier nor later: such rows delete nothing from each other. Extra columns of any
name are kept. A document all of whose words were deleted keeps an empty text. Blocks of equal length need no order: all go.
Empty tables give no rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderflow.llm.common import attach, discard, materialize, small, texts, whole_row


def line_key(line: str) -> tuple[int, int]:
    """(signed 64-bit hash of the line with blanks folded, its number of words); 0 for a line without words."""
    import xxhash

    words = line.split()
    if not words:
        return 0, 0
    h = xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >= 1 << 63 else h, len(words)


LINES = "doc_id long, text_key long, lines array<long>, words array<int>, runs array<long>"
#: Odd base (3 mod 4) of the run hashes modulo 2**64, and what a blank line counts as.
BASE, BLANK = 0x9E3779B97F4A7C17, 0xD6E8FEB86659FD93


def runs(lines: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signed hash, first line, line after the last) of the shortest runs of min_words words from and to each line."""
    n = len(lines)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    if total[-1] < min_words:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.arange(n)
    ends = np.searchsorted(total, total[:-1] + min_words, "left")
    starts = np.searchsorted(total, total[1:] - min_words, "right") - 1
    low, high = np.unique(np.concatenate([np.stack([place, ends])[:, ends <= n], np.stack([starts, place + 1])[:, starts >= 0]], axis=1), axis=1)
    one = np.asarray(lines, dtype=np.int64).astype(np.uint64)
    one[one == 0] = BLANK
    powers = lambda x: np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, x, dtype=np.uint64)]))
    power, inverse = powers(BASE), powers(pow(BASE, -1, 1 << 64))
    prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(one * power[:-1], dtype=np.uint64)])
    return ((prefix[high] - prefix[low]) * inverse[low]).view(np.int64), low, high


def _lines(min_words: int):
    """Lines, words of each, and the distinct runs of each document."""

    def run(batches):
        for b in batches:
            hashes, words, found = [], [], []
            for text in b.column("text").to_pylist():
                keys = [line_key(x) for x in text.split("\n")]
                hashes.append([k for k, _ in keys])
                words.append([n for _, n in keys])
                found.append(np.unique(runs(hashes[-1], words[-1], min_words)[0]))
            columns = [pa.array(x, pa.list_(t)) for x, t in ((hashes, pa.int64()), (words, pa.int32()), (found, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *columns], names=["doc_id", "text_key", "lines", "words", "runs"])

    return run


def _chain(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of points, sorted by their second number, whose first numbers rise."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(points)
    for n, (i, _) in enumerate(points):
        k = bisect.bisect_left(tails, i)
        before[n] = ends[k - 1] if k else -1
        tails[k:k + 1], ends[k:k + 1] = [i], [n]
    out = []
    n = ends[-1] if ends else -1
    while n >= 0:
        out.append(points[n])
        n = before[n]
    return out[::-1]


def align(early: list[int], late: list[int]) -> list[tuple[int, int, int]]:
    """Patience diff: (place in early, place in late, length) of the aligned common blocks; blank lines are 0."""
    blocks: list[tuple[int, int, int]] = []
    waiting = [(0, len(early), 0, len(late))]
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        places: dict[int, int] = {}
        for i in range(a0, a1):
            places[early[i]] = -1 if early[i] in places else i
        own: dict[int, int] = {}
        for j in range(b0, b1):
            own[late[j]] = -1 if late[j] in own else j
        points = [(places[x], j) for x, j in own.items() if x and j >= 0 and places.get(x, -1) >= 0]
        low_i, low_j, fresh = a0, b0, []
        for i, j in _chain(sorted(points, key=lambda p: p[1])):
            if i < low_i or j < low_j:
                continue  # inside the block before
            a, b, x, y = i, j, i + 1, j + 1
            while a > low_i and b > low_j and early[a - 1] == late[b - 1]:
                a, b = a - 1, b - 1
            while x < a1 and y < b1 and early[x] == late[y]:
                x, y = x + 1, y + 1
            fresh.append((a, b, x - a))
            waiting.append((low_i, a, low_j, b))
            low_i, low_j = x, y
        if fresh:
            waiting.append((low_i, a1, low_j, b1))
            waiting = [w for w in waiting if w[0] < w[1] and w[2] < w[3]]
            blocks += fresh
    return sorted(blocks)


def common_lines(early: list[int], early_words: list[int], late: list[int], words: list[int], min_words: int) -> list[int]:
    """Numbers of the lines of late in common blocks of at least min_words words."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    gone = np.zeros(len(late), bool)
    held: dict[int, int] = {}
    for h, low in zip(*(x.tolist() for x in runs(early, early_words, min_words)[:2]), strict=True):
        held.setdefault(h, low)
    shared = [(held[h], low, high) for h, low, high in zip(*(x.tolist() for x in runs(late, words, min_words)), strict=True) if h in held]
    begin = 0
    while begin is not None:  # patience diff of what is left, piece by piece, until it finds nothing more
        left = [r for r in shared if not gone[r[1] : r[2]].all()]
        begin, rest = None, np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
        for low, high in zip(rest[::2].tolist(), rest[1::2].tolist(), strict=True):
            if any(r[1] >= low and r[2] <= high for r in left):
                for _, j, n in align(early, late[low:high]):
                    if total[low + j + n] - total[low + j] >= min_words:
                        gone[low + j : low + j + n] = True
                        begin = low
    for i, low, high in shared:  # runs that are left: their first place in early is the fixed point
        if gone[low:high].all():
            continue
        a, b, x, y = i, low, i, low
        while a > 0 and b > 0 and early[a - 1] == late[b - 1]:
            a, b = a - 1, b - 1
        while x < len(early) and y < len(late) and early[x] == late[y]:
            x, y = x + 1, y + 1
        if total[y] - total[b] >= min_words:
            gone[b:y] = True
    return np.flatnonzero(gone).tolist()


def _deletions(min_words: int):
    def run(batches):
        for b in batches:
            pairs = zip(*(b.column(c).to_pylist() for c in ("early", "early_words", "lines", "words")), strict=True)
            out = [common_lines(*p, min_words) for p in pairs]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "text_key", "gone"])

    return run


def deletions(df: DataFrame, min_words: int = 25, hot_docs: int = 2_000) -> DataFrame:
    """doc_id, text_key and the sorted numbers of the lines to delete, for the documents that lose any."""
    docs = texts(df.where(F.col("doc_id").isNotNull()), "doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"))
    lines = materialize(docs.mapInArrow(_lines(min_words), LINES), "dedup-lines")
    held = lines.select("doc_id", "text_key", F.explode("runs").alias("run"))
    first = held.groupBy("run").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first.doc_id < last")
    first = materialize(first.select("run", F.col("first.doc_id").alias("first"), F.col("first.text_key").alias("first_key"), "n"), "dedup-first")
    hot = first.where(F.col("n") >= hot_docs).drop("n")  # runs of very many documents stay out of the shuffle by run
    if hot.isEmpty():
        met = held.join(first.drop("n"), "run")
    else:
        hot = small(materialize(hot, "dedup-hot"))
        met = held.join(hot, "run").unionByName(held.join(hot, "run", "left_anti").join(first.where(F.col("n") < hot_docs).drop("n"), "run"))
    pairs = materialize(met.where("first < doc_id").select("doc_id", "text_key", "first", "first_key").distinct(), "dedup-pairs")
    one = lines.select("doc_id", "text_key", "lines", "words")
    used = pairs.select("doc_id", "text_key").union(pairs.select("first", "first_key")).distinct()
    one = one.join(small(materialize(used, "dedup-used")), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    one = materialize(one, "dedup-texts")
    both = attach(pairs, one, {"first": "doc_id", "first_key": "text_key"}, {"early": "lines", "early_words": "words"})
    both = attach(both, one, {"doc_id": "doc_id", "text_key": "text_key"}, {"lines": "lines", "words": "words"}, counted=pairs)
    gone = both.mapInArrow(_deletions(min_words), "doc_id long, text_key long, gone array<int>").where("size(gone) > 0")
    gone = gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
    gone = materialize(gone, "dedup-gone")
    discard(lines, first, pairs, one)
    return gone


def dedup(df: DataFrame, min_words: int = 25) -> DataFrame:
    """The documents without the deleted lines: row (all columns; n_chars follows), n_lines and n_deleted (numbers)."""
    gone = deletions(df, min_words).withColumnRenamed("doc_id", "of")
    keyed = whole_row(df).withColumn("key", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    same = (F.col("row.doc_id") == F.col("of")) & (F.col("key") == F.col("text_key"))
    both = keyed.join(small(gone, elements="gone"), same, "left").select("row", "gone")
    text, lines = F.col("row.text"), F.split("row.text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    new = F.col("row").withField("text", kept)
    if "n_chars" in df.columns:
        new = new.withField("n_chars", F.length(kept).cast(df.schema["n_chars"].dataType))
    return both.select(
        F.when(F.col("gone").isNull(), F.col("row")).otherwise(new).alias("row"),
        F.when(text.isNull() | (text == ""), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"),
    )


def left_over(deduped: DataFrame) -> DataFrame:
    """The documents, with their own columns only, of which anything is left, or that lost nothing; from dedup()."""
    return deduped.where((F.col("n_deleted") == 0) | (F.regexp_replace("row.text", r"\s+", "") != "")).select("row.*")


def digest(deduped: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_deleted, kept_chars, kept_sha256, from dedup()."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return deduped.select("row.doc_id", "n_lines", "n_deleted", F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))
