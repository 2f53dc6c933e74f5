"""Best-fit packing of token sequences by a linear grouping scheme.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece lengths (``capacity`` numbers) comes
to the driver, which plans there for any number of documents:

1. large lengths, in descending order, are cut into groups of equal cardinality, each rounded up to its largest length;
2. the few rounded sizes are packed by optimised configurations (column generation over a knapsack, then rounded down);
3. each slot of a configuration is given to actual documents of its group, longest first;
4. what is left, and the small lengths, are put best-fit into the room that remains.

The plan is a list of runs (length, rank, number, first sequence, offset). A piece finds its place by its length and its
rank among the pieces of that length, which is its rank in its task plus the number in earlier tasks.

Defined results: null text is the empty text (one token, the end). Repeated rows are documents of their own. Extra
columns are ignored; an empty table gives no rows; texts of any length are cut, never shortened.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderflow.llm.byte_bpe import ByteBPE
from ladderflow.llm.common import materialize, texts, worker_cache

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n tokens: all full but the first, which may be shorter."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first)] + [(i, i + capacity) for i in range(first, n, capacity)]


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        bpe = worker_cache(("byte-bpe", path), lambda: ByteBPE(path))
        seen, task = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(bpe.encode(text), np.uint32(end_id)).astype("<u4")
                for i, (begin, stop) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, i, begin, stop - begin, zlib.crc32(ids[begin:stop].tobytes()), task, int(seen[stop - begin])))
                    seen[stop - begin] += 1
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return run


def groups_of(large: list[tuple[int, int]], n_groups: int) -> list[list[tuple[int, int]]]:
    """Linear grouping: (length, number) in descending order, cut into n_groups of equal cardinality."""
    total = sum(n for _, n in large)
    groups, room, begun = [], 0, 0
    for length, n in large:
        while n:
            if not room:
                groups.append([])
                begun += 1
                room = total * begun // n_groups - total * (begun - 1) // n_groups
                if not room:
                    groups.pop()
                    continue
            m = min(n, room)
            groups[-1].append((length, m))
            n, room = n - m, room - m
    merged: dict[int, list[tuple[int, int]]] = {}
    for g in groups:  # groups that round up to one size are one
        merged.setdefault(g[0][0], []).extend(g)
    return list(merged.values())


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, float]]:
    """(copies of each size, how often) of an optimal fractional packing, by column generation."""
    m = len(sizes)
    columns = np.diag([float(capacity // s) for s in sizes])
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ np.array(demand, float)
    for _ in range(rounds):
        value = inverse.sum(0)  # dual price of each size: all costs are 1
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        fits: list[int] = []
        for c in range(1, capacity + 1):  # knapsack by capacity
            best[c] = best[c - 1]
            while len(fits) < m and sizes[m - 1 - len(fits)] <= c:  # sizes are in descending order
                fits.append(m - 1 - len(fits))
            if fits:
                at = np.array(fits)
                gain = best[c - np.array(sizes)[at]] + value[at]
                k = int(gain.argmax())
                if gain[k] > best[c] + 1e-12:
                    best[c], choice[c] = gain[k], at[k]
        if best[capacity] <= 1 + 1e-9:
            break
        column, c = np.zeros(m), capacity
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                column[choice[c]] += 1
                c -= sizes[choice[c]]
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        by = ratio[out]
        x = x - by * step
        x[out] = by
        columns[:, out] = column
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    return [(columns[:, j].astype(int), float(x[j])) for j in range(m) if x[j] > 0]


class _Bins:
    """Runs of equal sequences by the room that is left in each."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room, self.done = capacity, {}, []

    def add(self, room: int, n: int, slots: tuple[int, ...]) -> None:
        if room:
            self.by_room.setdefault(room, []).append((n, slots))
        else:
            self.done.append((n, slots))

    def best_fit(self, length: int, n: int) -> None:
        """Puts n pieces of one length, each where the least room remains."""
        while n:
            room = min((r for r in self.by_room if r >= length), default=self.capacity)
            if self.by_room.get(room):
                have, slots = self.by_room[room].pop()
                if not self.by_room[room]:
                    del self.by_room[room]
            else:
                have, slots = n, ()
            each = min(room // length, n)
            used = min(have, n // each)
            if have > used and slots:
                self.add(room, have - used, slots)
            self.add(room - each * length, used, slots + (length,) * each)
            n -= used * each

    def all(self) -> list[tuple[int, tuple[int, ...]]]:
        return self.done + [run for runs in self.by_room.values() for run in runs]


def plan(histogram: dict[int, int], capacity: int = 1024, n_groups: int = 64, smalls: tuple[float, ...] = (0.34, 0.41, 0.45, 0.49)) -> np.ndarray:
    """The plan of fewest sequences among those that call lengths below these shares of the capacity small."""
    plans = [plan_with(histogram, capacity, n_groups, int(share * capacity)) for share in smalls]
    return min(plans, key=lambda runs: int((runs[:, 2] + runs[:, 3]).max(initial=0)))


def plan_with(histogram: dict[int, int], capacity: int, n_groups: int, small: int) -> np.ndarray:
    """Runs (length, first rank, number, first sequence, offset), sorted by length and rank."""
    bins = _Bins(capacity)
    if histogram.get(capacity):
        bins.add(0, histogram[capacity], (capacity,))
    left = {x: n for x, n in histogram.items() if x < capacity and n}
    large = sorted(((x, n) for x, n in left.items() if x >= small), reverse=True)
    groups = groups_of(large, n_groups)
    if groups:
        sizes = [g[0][0] for g in groups]
        stock = [list(g) for g in groups]  # actual documents of each group, longest first
        for copies, often in sorted(configurations(sizes, [sum(n for _, n in g) for g in groups], capacity), key=lambda p: tuple(-p[0])):
            _fill(bins, stock, copies, int(often + 1e-6), left)
    for length in sorted((x for x, n in left.items() if n), reverse=True):
        bins.best_fit(length, left[length])
    rank, runs, first = dict.fromkeys(histogram, 0), [], 0
    for n, slots in bins.all():
        offset = 0
        for length in slots:
            runs.append((length, rank[length], n, first, offset))
            rank[length] += n
            offset += length
        first += n
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def _fill(bins: _Bins, stock: list[list[tuple[int, int]]], copies: np.ndarray, n: int, left: dict[int, int]) -> None:
    """n sequences of one configuration, its slots given to actual documents."""
    used = [(g, int(k)) for g, k in enumerate(copies) if k]
    while n > 0 and all(sum(m for _, m in stock[g]) >= k for g, k in used):
        m = min([n, *(stock[g][0][1] // k for g, k in used)])
        slots: list[int] = []
        for g, k in used:
            if m:
                length, have = stock[g][0]
                slots += [length] * k
                left[length] -= m * k
                stock[g][0] = (length, have - m * k)
            else:
                for _ in range(k):
                    length, have = stock[g][0]
                    slots.append(length)
                    left[length] -= 1
                    stock[g][0] = (length, have - 1)
                    if have == 1:
                        stock[g].pop(0)
            if stock[g] and not stock[g][0][1]:
                stock[g].pop(0)
        bins.add(bins.capacity - sum(slots), max(1, m), tuple(slots))
        n -= max(1, m)


def _place(runs: np.ndarray):
    """Sequence and offset of each piece, by its length and rank."""
    keys = runs[:, 0] * (1 << 48) + runs[:, 1]

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            r = runs[at]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(r[:, 3] + rank - r[:, 1]), pa.array(r[:, 4])],
                names=[c.split()[0] for c in PLACED.split(", ")],
            )

    return run


def pack(df: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, n_groups: int = 64) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(texts(df, "doc_id").mapInArrow(_pieces(tokenizer_path, capacity, end_id), PIECES), "packing-pieces")
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranked = pieces.join(before.drop("n"), ["task", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    runs = plan(histogram, capacity, n_groups)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(runs), PLACED)
