"""N-gram Jaccard join with signature trees.

A document's set holds its distinct shingles of five words; two documents link when 100 * |A & B| >= 80 * |A | B|.

1. One pass gives each document its set's size, a 128-bit digest and a token bitmap, so that equal sets become one class;
   it also counts shingles that repeat within blocks of the corpus, which tells frequent shingles.
2. Of each set the first n - ceil(0.8 n) + 1 shingles, frequent ones last and else by hash, go to groups: linked sets
   always meet in one. The order alone decides how large groups get, never the result.
3. In each group every set is compared with the group's leader, the set whose shingles are the most frequent on average
   (the likely source of a family of copies): the number of pairs grows with the rows of a group, not with their square.
   Linked sets become components.
4. For groups that still hold several components, one of each list of members, signature trees are built: nodes hold
   OR-combined bitmaps and size ranges, leaves hold documents. A dual traversal, a bounded number of node pairs at a time,
   drops node pairs of one component, of sizes too far apart, and of too small a maximum overlap. A pair of sets is given
   only by the first of the groups in which both are, so its rows do not multiply by the shingles that it shares. What
   remains is verified on the whole sets.
5. Large-star/small-star steps give the components of all links.

Groups of more than ``part_rows`` sets in step 4 are dealt out in blocks: parts of the group's main component against parts
of the other sets, and those against each other, so that a task holds at most two parts. In step 2 the groups of frequent
shingles are split by ``salt_rows``. A shingle that no block of ``block`` shingles repeats is less than 2 / block of all
shingles, and its group (a stream that is not held) less than 10 / block of all prefix rows: below one task's share as
long as there are fewer than block / 10 tasks.

Pairs in step 4 are those that bitmaps allow: sets of one family whose overlap is just too small for a link and that no
component joins can still be many. They are compared, never dropped.

Broadcast are only the list of frequent shingles (at most ``hot_rows``), ids of at most ``broadcast_ids`` documents and
tables whose measured size is small; beyond that a shuffle join does the same.

Defined results: null and empty texts, and texts of white space, have no shingles and are linked with nothing; texts of
fewer than five words have their whole sequence as one shingle. Rows that repeat a doc_id are one document to others. Rows
without doc_id take no part and get a null component. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderflow.llm.common import discard, materialize, small, texts, worker_cache
from ladderflow.llm.components import components

#: Bits of a token bitmap in a tree; a document's own bitmap is wider if its set is larger.
BITS = 1024
MOST_BITS = 1 << 16
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(8)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, kept from text to text."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, known: Words, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text. bytes.lower() and bytes.split() treat exactly A-Z
    and the white space of the contract."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(words) < size:
        total = sum(int(x) * int(_POWERS[i]) for i, x in enumerate(h)) + len(words) * 0x632BE59BD9B4E019
        return _mix(np.array([total & ((1 << 64) - 1)], np.uint64))
    n = len(words) - size + 1
    out = h[:n] * _POWERS[0]
    for k in range(1, size):
        out += h[k : k + n] * _POWERS[k]
    return np.unique(_mix(out))


def least_overlap(n: int) -> int:
    """The least overlap of a set of n with any set that it links with."""
    return (4 * n + 4) // 5


SETS = "kind int, doc_id long, n int, k1 long, k2 long, bits binary"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    """A set's bits by the low bits of its hashes, about as many as it has shingles; halves ORed give a narrower one."""
    width = min(MOST_BITS, max(BITS, 1 << max(0, len(s) - 1).bit_length()))
    flags = np.zeros(width, bool)
    flags[s & np.uint64(width - 1)] = True
    return np.packbits(flags).tobytes()


def fold(raw: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of at least a width, narrowed to it: one row each."""
    out = np.empty((len(raw), width // 64), np.uint64)
    for i, r in enumerate(raw):
        np.bitwise_or.reduce(np.frombuffer(r, np.uint64).reshape(-1, width // 64), axis=0, out=out[i])
    return out


def _sets(block: int):
    """kind 0: one row for each document; kind 1: a shingle (in doc_id) and how often (n) a block of the corpus has it."""

    def run(batches):
        known = worker_cache(("shingle-words",), Words)
        waiting: list[np.ndarray] = []
        size = 0

        def repeated():
            h, count = np.unique(np.concatenate(waiting), return_counts=True)
            h, count = h[count > 1], count[count > 1]
            none = pa.nulls(len(h), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(h), np.int32)), pa.array(_signed(h)), pa.array(count.astype(np.int32)), none, none, pa.nulls(len(h), pa.binary())],
                names=["kind", "doc_id", "n", "k1", "k2", "bits"],
            )

        for b in batches:
            n, k1, k2, bits = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, known)
                n.append(len(s))
                k1.append(int(_signed(_mix(s).sum(dtype=np.uint64).reshape(1))[0]))
                k2.append(int(_signed(_mix(s * _POWERS[3]).sum(dtype=np.uint64).reshape(1))[0]))
                bits.append(bitmap(s))
                waiting.append(s)
                size += len(s)
                if size >= block:
                    yield repeated()
                    waiting, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(n), np.int32)), b.column("doc_id"), pa.array(n, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bits, pa.binary())],
                names=["kind", "doc_id", "n", "k1", "k2", "bits"],
            )
        if waiting:
            yield repeated()

    return run


class Order:
    """Global order of shingles: frequent ones last (by their count), else by hash."""

    def __init__(self, hot: np.ndarray, count: np.ndarray, salt_rows: int):
        by = np.argsort(hot)
        self.hot, self.count, self.salt_rows = hot[by], count[by], salt_rows
        self.low = np.zeros(1 << 20, bool)
        self.low[hot & np.uint64((1 << 20) - 1)] = True

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The first shingles of a set in this order, into how many parts the group of each is split, and how frequent
        the set's shingles are on average (in thousandths)."""
        size = len(s) - least_overlap(len(s)) + 1
        maybe = np.flatnonzero(self.low[s & np.uint64((1 << 20) - 1)]) if len(self.hot) else []
        if not len(maybe):
            return s[:size], np.ones(size, np.int64), 0
        at = np.minimum(np.searchsorted(self.hot, s[maybe]), len(self.hot) - 1)
        count = np.zeros(len(s), np.int64)
        count[maybe] = np.where(self.hot[at] == s[maybe], self.count[at], 0)
        order = np.lexsort((s, count))[:size]
        return s[order], 1 + count[order] // self.salt_rows, int(min(count.mean() * 1000, 2**31 - 1))


def _prefixes(order: Order):
    """(h, salt, typical, k1, n) of each prefix shingle; within a batch equal sets send one row."""

    def run(batches):
        known = worker_cache(("shingle-words",), Words)
        for b in batches:
            parts, seen = [], set()
            for text in b.column("text").to_pylist():
                s = shingles(text, known)
                if not len(s):
                    continue
                k1 = _mix(s).sum(dtype=np.uint64)
                if (int(k1), len(s)) in seen:
                    continue
                seen.add((int(k1), len(s)))
                h, split, typical = order.prefix(s)
                salt = np.where(split > 1, 1 + (k1 >> np.uint64(20)).astype(np.int64) % split, 0).astype(np.int32)
                parts.append((h, salt, np.full(len(h), typical, np.int32), np.full(len(h), k1), np.full(len(h), len(s), np.int32)))
            if parts:
                h, salt, typical, k1, n = (np.concatenate(c) for c in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(h)), pa.array(salt), pa.array(typical), pa.array(_signed(k1)), pa.array(n)], names=["h", "salt", "typical", "k1", "n"])

    return run


GROUPED = "h long, salt int, k1 long, n int, leader long, leader_n int"


def _leaders(batches):
    """Rows sorted by (h, salt, typical from the top, k1) that share their group with another set, each with its first row."""
    group = leader = leader_n = previous = None
    given = False  # whether the first row of the group that a batch ends in has been given
    for b in batches:
        h, salt, k1, n = (b.column(c).to_numpy() for c in ("h", "salt", "k1", "n"))
        if not len(h):
            continue
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])
        new[0] = group != (h[0], salt[0])
        same = np.zeros(len(h), bool)  # a set that the row before already gave
        same[1:] = ~new[1:] & (k1[1:] == k1[:-1])
        same[0] = not new[0] and previous == k1[0]
        gid = np.cumsum(new)  # 0: the group that the batch before ended in
        first = np.r_[0, np.flatnonzero(new)][gid]
        lead = np.where(gid > 0, k1[first], 0 if leader is None else leader)
        lead_n = np.where(gid > 0, n[first], 0 if leader_n is None else leader_n)
        follows = np.flatnonzero(~new & ~same & (k1 != lead))
        groups, at = np.unique(gid[follows], return_index=True)
        fresh = (groups > 0) | (not given)
        lone = follows[at[fresh]]  # for each group that is not given yet: a row that knows its first row
        solo = np.flatnonzero(new & (salt > 0))  # parts of split groups give their first row at once, even if it stays alone
        lone = np.r_[lone[salt[lone] == 0], solo]
        rows = [np.r_[x[lone], y[follows]] for x, y in ((h, h), (salt, salt), (lead, k1), (lead_n, n), (lead, lead), (lead_n, lead_n))]
        given = bool(len(groups) and groups[-1] == gid[-1]) or (gid[-1] == 0 and given)
        group, leader, leader_n, previous = (h[-1], salt[-1]), lead[-1], lead_n[-1], k1[-1]
        if len(rows[0]):
            kinds = (np.int64, np.int32, np.int64, np.int32, np.int64, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(rows, kinds, strict=True)], names=["h", "salt", "k1", "n", "leader", "leader_n"])


def sizes_fit(a: str, b: str):
    """Sizes of which one is at least 0.8 of the other."""
    return (F.col(a) * 5 >= F.col(b) * 4) & (F.col(b) * 5 >= F.col(a) * 4)


def may_link(na: np.ndarray, a: np.ndarray, nb: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the bitmaps of sets allow a link: each bit of one that the other lacks is a token that the other lacks."""
    most = np.minimum(na - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
    return most * 9 >= (na + nb) * 4


def pairs_may_link(n: np.ndarray, raw: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """may_link() of the pairs of places (a, b), each at the narrower of the two widths."""
    n, width = n.astype(np.int64), np.array([len(r) * 8 for r in raw], np.int64)
    at, ok = np.minimum(width[a], width[b]), np.zeros(len(a), bool)
    for w in np.unique(at).tolist():
        rows = np.flatnonzero(at == w)
        step = max(1, (1 << 26) // w)
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            used, back = np.unique(np.r_[a[part], b[part]], return_inverse=True)
            m = fold([raw[k] for k in used.tolist()], w)
            x, y = back[: len(part)], back[len(part) :]
            ok[part] = may_link(n[a[part]], m[x], n[b[part]], m[y])
    return ok


def _prune_pairs(batches):
    for b in batches:
        k = b.num_rows
        n = np.r_[b.column("an").to_numpy(), b.column("bn").to_numpy()]
        raw = b.column("abits").to_pylist() + b.column("bbits").to_pylist()
        yield b.select(["u", "v"]).filter(pa.array(pairs_may_link(n, raw, np.arange(k), np.arange(k) + k)))


class SignatureTree:
    """Nodes over sets in order of size: OR-combined bitmap, size range, most tokens beyond the bits, single component."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, comp: np.ndarray, fanout: int = 8):
        self.order = np.lexsort((comp, n))
        n, bits, comp = n[self.order].astype(np.int64), bits[self.order], comp[self.order]
        level = {"bits": bits, "low": n, "high": n, "spare": n - np.bitwise_count(bits).sum(1, dtype=np.int64), "one": comp, "single": np.ones(len(n), bool)}
        self.levels, self.fanout = [level], fanout
        while len(level["low"]) > 1:
            cut = np.arange(0, len(level["low"]), fanout)
            one_low, one_high = np.minimum.reduceat(level["one"], cut), np.maximum.reduceat(level["one"], cut)
            level = {
                "bits": np.bitwise_or.reduceat(level["bits"], cut), "low": np.minimum.reduceat(level["low"], cut), "high": np.maximum.reduceat(level["high"], cut),
                "spare": np.maximum.reduceat(level["spare"], cut), "one": one_low, "single": np.logical_and.reduceat(level["single"], cut) & (one_low == one_high),
            }
            self.levels.append(level)

    def walk(self, at_once: int = 8192):
        """Places of all pairs of sets in different components that may link, in pieces: a dual traversal from the root
        down, that opens at_once pairs of nodes at a time."""
        step = np.arange(self.fanout)
        waiting = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while waiting:
            depth, a, b = waiting.pop()
            if len(a) > at_once:
                waiting.append((depth, a[at_once:], b[at_once:]))
                a, b = a[:at_once], b[:at_once]
            keep = self._may(self.levels[depth], a, b)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if not depth:
                keep = a < b
                yield self.order[a[keep]], self.order[b[keep]]
                continue
            below = len(self.levels[depth - 1]["low"])
            a = (a[:, None, None] * self.fanout + step[None, :, None] + 0 * step[None, None, :]).reshape(-1)
            b = (b[:, None, None] * self.fanout + step[None, None, :] + 0 * step[None, :, None]).reshape(-1)
            keep = (a < below) & (b < below) & (a <= b)
            waiting.append((depth - 1, a[keep], b[keep]))

    @staticmethod
    def _may(x: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs of nodes of a level may hold sets of different components that link."""
        keep = (x["high"][a] * 5 >= x["low"][b] * 4) & (x["high"][b] * 5 >= x["low"][a] * 4)
        keep &= ~(x["single"][a] & x["single"][b] & (x["one"][a] == x["one"][b]))
        at = np.flatnonzero(keep)
        a, b = a[at], b[at]
        shared = np.bitwise_count(x["bits"][a] & x["bits"][b]).sum(1, dtype=np.int64)
        most = np.minimum(np.minimum(x["spare"][a], x["spare"][b]) + shared, np.minimum(x["high"][a], x["high"][b]))
        keep[at] = most * 9 >= (x["low"][a] + x["low"][b]) * 4
        return keep

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All of walk() at once."""
        found = [*self.walk(), (np.empty(0, np.int64), np.empty(0, np.int64))]
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


#: side: sets of one side of a block are not compared with each other; those of side ANY are.
ANY = 2
TREE_ROWS = ("h", "part", "side", "rep", "n", "comp", "bits", "groups")


def _group_pairs(h: int, side: np.ndarray, ids: np.ndarray, n: np.ndarray, comp: np.ndarray, raw: list[bytes], groups: list[list[int]]):
    """Pieces of candidate pairs (u, v) of one block of one group, of which h is the first common group."""
    if len(n) < 2 or (comp == comp[0]).all():
        return
    before: dict[int, frozenset] = {}

    def earlier(i: int) -> frozenset:
        if i not in before:
            before[i] = frozenset(g for g in groups[i] if g < h)
        return before[i]

    for a, b in SignatureTree(n, fold(raw, BITS), np.where(side == ANY, comp, side)).walk():
        ok = comp[a] != comp[b]
        a, b = a[ok], b[ok]
        ok = np.fromiter((earlier(i).isdisjoint(earlier(j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
        a, b = a[ok], b[ok]
        ok = pairs_may_link(n, raw, a, b)
        if ok.any():
            a, b = ids[a[ok]], ids[b[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])


def _tree_pairs(batches):
    """Candidate pairs (u, v) of each (h, part); rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    key = None

    def solve():
        t = pa.Table.from_batches(held).combine_chunks()
        h, part = t.column("h").to_numpy(), t.column("part").to_numpy()
        edge = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])])
        side, ids, n, comp = (t.column(c).to_numpy() for c in ("side", "rep", "n", "comp"))
        for begin, end in zip(edge.tolist(), [*edge[1:].tolist(), len(h)], strict=True):
            p, rows = slice(begin, end), t.slice(begin, end - begin)
            yield from _group_pairs(int(h[begin]), side[p], ids[p], n[p], comp[p], rows.column("bits").to_pylist(), rows.column("groups").to_pylist())

    for b in batches:
        if not b.num_rows:
            continue
        h, part = b.column("h").to_numpy(), b.column("part").to_numpy()
        tail = int(np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])])[-1])
        if key != (h[0], part[0]) and held:
            yield from solve()
            held = []
        if tail:  # all groups but the last are whole
            held.append(b.slice(0, tail))
            yield from solve()
            held = []
        held.append(b.slice(tail))
        key = (h[-1], part[-1])
    if held:
        yield from solve()


def _blocks(rows: DataFrame, part_rows: int) -> DataFrame:
    """rows (h, c, rep, n, comp, main) dealt out to blocks (part, side) of at most about 2 * part_rows of a group."""
    if (rows.agg(F.max("c")).first()[0] or 0) <= part_rows:
        return rows.select("h", F.lit(1).cast("long").alias("part"), F.lit(ANY).alias("side"), "rep", "n", "comp")
    parts = rows.where(F.col("c") > part_rows).groupBy("h").agg(*(F.ceil(F.sum(x.cast("int")) / part_rows).cast("int").alias(name) for x, name in ((F.col("main"), "ms"), (~F.col("main"), "os"))))
    rows = rows.join(small(materialize(parts, "jaccard-parts")), "h", "left")
    own = lambda of: F.pmod(F.xxhash64("rep"), F.greatest(F.col(of), F.lit(1)).cast("bigint"))
    place = lambda i, j, kind, side: F.struct(((i.cast("long") * (1 << 24) + j) * 2 + kind).alias("part"), side.cast("int").alias("side"))
    upto = lambda of: F.when(F.col(of) > 0, F.sequence(F.lit(0), F.col(of) - 1)).otherwise(F.array().cast("array<int>"))
    mixed = F.transform(upto("os"), lambda t: place(own("ms"), t, 0, F.lit(0)))
    crossed = F.transform(upto("ms"), lambda t: place(t, own("os"), 0, F.lit(1)))
    among = F.transform(upto("os"), lambda t: place(F.least(own("os"), t), F.greatest(own("os"), t), 1, F.when(own("os") == t, ANY).when(own("os") < t, 0).otherwise(1)))
    whole = F.array(place(F.lit(0), F.lit(0), 1, F.lit(ANY)))
    rows = rows.withColumn("at", F.explode(F.when(F.col("ms").isNull(), whole).when(F.col("main"), mixed).otherwise(F.concat(crossed, among))))
    return rows.select("h", "at.part", "at.side", "rep", "n", "comp")


def _salted(pairs: DataFrame, side: str, salt_pairs: int) -> DataFrame:
    """Of each id on a side: in how many parts its pairs are joined."""
    return pairs.groupBy(side).agg((F.ceil(F.count("*") / salt_pairs)).cast("int").alias("parts"))


def verify(pairs: DataFrame, docs: DataFrame, broadcast_ids: int = 2_000_000, salt_pairs: int = 2_000) -> DataFrame:
    """The pairs (u, v) whose whole sets link. The set of an id with many pairs goes to one part for each salt_pairs of them."""
    pairs = materialize(pairs.distinct(), "jaccard-pairs")
    ids = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()
    if ids.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    wanted = docs.join(ids, "doc_id", "left_semi")

    def run(batches):
        known = worker_cache(("shingle-words",), Words)
        for b in batches:
            sets = [_signed(shingles(t, known)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "s"])

    sets = materialize(wanted.select("doc_id", "text").mapInArrow(run, "doc_id long, s array<long>"), "jaccard-sets")
    us, vs = (materialize(_salted(pairs, x, salt_pairs), "jaccard-parts") for x in "uv")
    dealt = pairs.join(small(us), "u").withColumn("i", F.pmod(F.xxhash64("v"), F.col("parts").cast("bigint"))).drop("parts")
    dealt = dealt.join(small(vs), "v").withColumn("j", F.pmod(F.xxhash64("u"), F.col("parts").cast("bigint"))).drop("parts")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("parts") - 1).cast("long")))
    a = sets.join(small(us), sets["doc_id"] == us["u"]).select("u", copies.alias("i"), F.col("s").alias("a"))
    b = sets.join(small(vs), sets["doc_id"] == vs["v"]).select("v", copies.alias("j"), F.col("s").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    linked = a.join(small(materialize(dealt, "jaccard-dealt")), ["u", "i"]).join(b, ["v", "j"]).where(common * 9 >= (F.size("a") + F.size("b")) * 4).select("u", "v").distinct()
    linked = materialize(linked, "jaccard-links")
    discard(pairs, sets, us, vs)
    return linked


def links(df: DataFrame, hot_rows: int = 200_000, hot_count: int = 4, block: int = 1_000_000, salt_rows: int = 100_000, part_rows: int = 8192) -> tuple[DataFrame, DataFrame]:
    """(sets: doc_id, n, rep; links u, v between representatives). Each set's rep is its smallest doc_id."""
    spark = df.sparkSession
    docs = texts(df.where(F.col("doc_id").isNotNull()), "doc_id")
    found = materialize(docs.mapInArrow(_sets(block), SETS), "jaccard-found")
    one = found.where("kind = 0")
    classes = one.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"))
    classes = materialize(classes, "jaccard-classes")
    hot = found.where("kind = 1").groupBy(F.col("doc_id").alias("h")).agg(F.sum("n").alias("c")).where(F.col("c") >= hot_count)
    hot = hot.orderBy(F.desc("c"), "h").limit(hot_rows).toPandas()
    order = Order(hot["h"].to_numpy(np.int64).view(np.uint64), hot["c"].to_numpy(np.int64), salt_rows)

    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    prefixes = docs.mapInArrow(_prefixes(order), "h long, salt int, typical int, k1 long, n int")
    in_order = ("h", "salt", F.desc("typical"), "k1", "n")
    grouped = prefixes.repartition(n_parts, "h", "salt").sortWithinPartitions(*in_order).mapInArrow(_leaders, GROUPED)
    grouped = materialize(grouped, "jaccard-grouped")
    met = grouped.where("k1 <> leader").where(sizes_fit("n", "leader_n")).select("k1", "n", "leader", "leader_n")
    if len(hot) and hot["c"].max() >= salt_rows:  # first rows of the parts of a split group meet each other
        heads = grouped.where("salt > 0").select("h", F.lit(0).alias("salt"), F.lit(0).alias("typical"), F.col("leader").alias("k1"), F.col("leader_n").alias("n")).distinct()
        heads = heads.repartition(n_parts, "h").sortWithinPartitions(*in_order).mapInArrow(_leaders, GROUPED)
        met = met.union(heads.where("k1 <> leader").where(sizes_fit("n", "leader_n")).select("k1", "n", "leader", "leader_n"))
    met = met.distinct()
    a = classes.select("k1", F.col("n"), F.col("rep").alias("u"), F.col("bits").alias("abits"), F.col("n").alias("an"))
    b = classes.select(F.col("k1").alias("leader"), F.col("n").alias("leader_n"), F.col("rep").alias("v"), F.col("bits").alias("bbits"), F.col("n").alias("bn"))
    pairs = met.join(a, ["k1", "n"]).join(b, ["leader", "leader_n"]).where("u <> v")
    first = verify(pairs.select("u", "v", "an", "abits", "bn", "bbits").mapInArrow(_prune_pairs, "u long, v long"), docs)

    comp = components(first)
    info = classes.join(comp, classes["rep"] == comp["id"], "left").select("k1", "n", "rep", F.coalesce("component", "rep").alias("comp"))
    info = materialize(info, "jaccard-info")
    rows = grouped.select("h", "k1", "n", (F.col("k1") == F.col("leader")).alias("leads")).join(small(info), ["k1", "n"])
    members = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"m{i}") for i in (1, 2)]
    mixed = rows.groupBy("h").agg(F.count("*").alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.when(F.col("leads"), F.col("comp"))).alias("main"), *members)
    once = mixed.where("low <> high").groupBy("c", "m1", "m2").agg(F.min("h").alias("h"), F.min_by("main", "h").alias("main"))
    once = materialize(once.select("h", "c", "main"), "jaccard-groups")
    rows = rows.join(small(once), "h").withColumn("main", F.coalesce(F.col("comp") == F.col("main"), F.lit(False)))
    rows = _blocks(rows.select("h", "c", "rep", "n", "comp", "main"), part_rows)
    by_size = Window.partitionBy("h", "part").orderBy("n", "rep")
    fits = (F.lag("n").over(by_size) * 5 >= F.col("n") * 4) | (F.col("n") * 5 >= F.lead("n").over(by_size) * 4)
    rows = rows_written = materialize(rows.withColumn("fits", fits).where("fits").drop("fits"), "jaccard-rows")  # the others have no set of a fitting size beside them
    groups = rows.groupBy("rep").agg(F.array_sort(F.collect_set("h")).alias("groups"))
    rows = rows.join(classes.groupBy("rep").agg(F.first("bits").alias("bits")), "rep").join(groups, "rep").select(*TREE_ROWS)
    trees = rows.repartition(n_parts, "h", "part").sortWithinPartitions("h", "part").mapInArrow(_tree_pairs, "u long, v long")
    second = verify(trees, docs)
    discard(grouped, info, once, rows_written)
    sets = one.join(small(classes.select("k1", "k2", "n", "rep")), ["k1", "k2", "n"], "left").select("doc_id", "n", "rep")
    return sets, first.union(second)


def join(df: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    sets, found = links(df, **sizes)
    comp = components(found)
    comp = materialize(comp, "jaccard-components")
    own = sets.join(small(comp), sets["rep"] == comp["id"], "left")
    out = own.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    lost = texts(df.where(F.col("doc_id").isNull()), "doc_id").mapInArrow(_sizes, "doc_id long, n_shingles long")
    return out.union(lost.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))


def _sizes(batches):
    known = Words()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(shingles(t, known)) for t in b.column("text").to_pylist()], pa.int64())], names=["doc_id", "n_shingles"])


def keep_one(df: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest doc_id, with all columns; documents without a doc_id, and
    those that nothing links with, stay. Rows that repeat the kept doc_id stay, too."""
    gone = materialize(join(df).where("doc_id is not null and component_id < doc_id").select("doc_id").distinct(), "jaccard-gone")
    return df.join(small(gone), "doc_id", "left_anti").select(*df.columns)
