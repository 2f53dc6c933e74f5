"""Document fingerprints by consistent weighted sampling.

Each text is a bag of lower-cased words; a word weighs its count times its length, so that short function words weigh
little. For each of ``n_samples`` samples and each word, r and c are Gamma(2, 1) and beta is uniform, all derived from
the hash of the word and the number of the sample. With t = floor(ln w / r + beta) and ln a = ln c - r (t - beta) - r the
sample is the (word, t) of least a; two texts agree in a sample with a probability equal to the generalised Jaccard
similarity of their weights. A fingerprint holds 16 bits of each sample's hash.

Defined results: null text is the empty text, whose samples are all 0; a text without words is one term by itself.
Equal texts have equal fingerprints. Repeated rows are rows of their own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderflow.llm.common import texts, worker_cache

#: Entries of a worker's table of sampled (word, count) pairs; beyond that it is started anew.
CACHE_ROWS = 100_000
#: Rows that are sampled at once, few enough for a core's cache.
SLICE = 256
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix_into(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        np.bitwise_xor(x, np.right_shift(x, np.uint64(shift), out=spare), out=x)
        np.multiply(x, np.uint64(factor), out=x)
    return np.bitwise_xor(x, np.right_shift(x, np.uint64(31), out=spare), out=x)


def _uniform(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform numbers in (0, 1) of 24 bits from each 64-bit hash."""
    halves = x.view(np.uint32).reshape(*x.shape, 2)
    number = lambda y: ((y >> np.uint32(8)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)
    return number(halves[..., 0]), number(halves[..., 1])


class Sampler:
    """Fingerprints of texts; keeps the samples of the words that it has met."""

    def __init__(self, n_samples: int = 64, cache_rows: int = CACHE_ROWS):
        self.k = n_samples
        seeds = np.arange(1, 3 * n_samples + 1, dtype=np.uint64) * _GOLDEN
        self.streams = _mix_into(seeds, np.empty_like(seeds)).reshape(3, n_samples)
        self.a = np.empty((cache_rows, n_samples), np.float32)
        self.bits = np.empty((cache_rows, n_samples), np.uint16)
        self.at: dict[tuple[str, int], int] = {}

    def sample(self, terms: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        """ln a and the hash bits of (word, count) pairs: one row each. Three hashes give the five uniform numbers."""
        h = np.array([int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w, _ in terms], np.uint64)
        weight = np.log(np.array([n * max(1, len(w)) for w, n in terms], np.float32))
        spare = np.empty((len(h), self.k), np.uint64)
        (r, r2), (ln_c, c2), (beta, _) = (_uniform(_mix_into(h[:, None] ^ s[None, :], spare)) for s in self.streams)
        r *= r2
        np.negative(np.log(r, out=r), out=r)
        ln_c *= c2
        np.log(np.negative(np.log(ln_c, out=ln_c), out=ln_c), out=ln_c)
        t = weight[:, None] / r
        t += beta
        np.floor(t, out=t)
        bits = _mix_into(t.astype(np.uint64) * _GOLDEN + h[:, None], spare)
        t -= beta
        t += 1
        t *= r
        ln_c -= t
        return ln_c, (bits >> np.uint64(48)).astype(np.uint16)

    def learn(self, bags: list[list[tuple[str, int]]]) -> None:
        """Samples all new pairs of a batch in slices."""
        new = list(dict.fromkeys(x for bag in bags for x in bag if x not in self.at))
        if len(self.at) + len(new) > len(self.a):
            self.at = {}
            new = list(dict.fromkeys(x for bag in bags for x in bag))
            if len(new) > len(self.a):  # one very long text
                self.a = np.empty((len(new), self.k), np.float32)
                self.bits = np.empty((len(new), self.k), np.uint16)
        first = len(self.at)
        for i in range(0, len(new), SLICE):
            rows = slice(first + i, first + min(i + SLICE, len(new)))
            self.a[rows], self.bits[rows] = self.sample(new[i : i + SLICE])
        self.at.update(zip(new, range(first, first + len(new)), strict=True))

    def prints(self, documents: list[str]) -> np.ndarray:
        """One row of n_samples numbers of 16 bits for each text."""
        out = np.zeros((len(documents), self.k), np.uint16)
        bags = [list(Counter(x.lower().split() or ([x] if x else [])).items()) for x in documents]
        columns = np.arange(self.k)
        for begin in range(0, len(bags), 20):
            some = bags[begin : begin + 20]
            self.learn(some)
            for i, bag in enumerate(some, begin):
                if bag:
                    rows = np.fromiter(map(self.at.__getitem__, bag), np.int64, len(bag))
                    out[i] = self.bits[rows[self.a[rows].argmin(0)], columns]
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(1)


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the beginning of the following one."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _run(n_samples: int):
    def run(batches):
        sampler = worker_cache(("sampler", n_samples), lambda: Sampler(n_samples))
        before = None  # (bucket, doc_id, text, its print or the place of it) that waits for its follower

        def rows(pairs):
            ids, own, changed, prints, following, edits = zip(*pairs, strict=True)
            p, q, e = np.array(prints), np.array(following), np.array(edits)
            hexed = lambda m: [bytes(x.astype(">u2").tobytes()).hex() for x in m]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([len(x) for x in own], pa.int64()),
                    pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed]),
                    pa.array(hexed(p)), pa.array(hexed(e)), pa.array(likeness(p, e)), pa.array(likeness(p, q)),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for b in batches:
            bucket, tail = b.column("bucket").to_pylist(), b.column("tail").to_pylist()
            ids, text = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            work, plan = [], []  # a text stands beside the edited text that shares its words, so words are sampled once
            for i in range(len(ids)):
                if before is not None and before[0] == bucket[i]:
                    changed = edited(before[2], text[i])
                    plan.append((before, changed, len(work), len(work) + 1))
                    work += [changed, text[i]]
                else:
                    work.append(text[i])
                before = None if tail[i] else (bucket[i], ids[i], text[i], len(work) - 1)
            prints = sampler.prints(work)
            pairs = []
            for (_, doc_id, own, at), changed, e, q in plan:
                pairs.append((doc_id, own, changed, prints[at] if isinstance(at, int) else at, prints[q], prints[e]))
            if before is not None:  # waits for the next batch with its print
                before = (*before[:3], prints[before[3]] if isinstance(before[3], int) else before[3])
            if pairs:
                yield rows(pairs)

    return run


def fingerprints(df: DataFrame, n_samples: int = 64, bucket_rows: int = 3000, max_buckets: int = 20_000) -> DataFrame:
    """Fingerprints of each text and of its edited text; the next document is the one before in doc_id.

    Documents are dealt into ranges of doc_id by approximate quantiles (at most max_buckets numbers on the driver);
    the first document of each range also goes, as tail, to the range before it, so each range is solved alone.
    Rows of one doc_id are ordered by text; a null doc_id counts as the smallest.
    """
    docs = texts(df, F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("key"), "doc_id")
    spark = df.sparkSession
    n = docs.count()
    if not n:
        return spark.createDataFrame([], OUT)
    cores = spark.sparkContext.defaultParallelism
    n_buckets = max(1, min(max_buckets, max(n // bucket_rows, min(cores, n // 64))))
    cuts = docs.select("key").agg(F.percentile_approx("key", [i / n_buckets for i in range(1, n_buckets)] or [0.5], 10 * n_buckets)).first()[0]
    cuts = sorted(set(cuts)) if n_buckets > 1 else []
    bucket = F.lit(0)
    if cuts:  # binary search in the sorted cuts, descending ids first
        edges = np.array(cuts, np.int64)
        bucket = _bucket(edges)(F.col("key"))
    numbered = docs.withColumn("bucket", bucket)
    tops = numbered.groupBy("bucket").agg(F.max("key").alias("key")).orderBy("bucket").collect()
    to = {tops[i]["key"]: tops[i - 1]["bucket"] for i in range(len(tops))}  # the first goes behind the last
    heads = F.broadcast(spark.createDataFrame([(k, b) for k, b in to.items()], "key long, before int"))
    own = numbered.withColumn("tail", F.lit(False))
    tails = numbered.join(heads, "key").select("key", "doc_id", "text", F.col("before").alias("bucket"), F.lit(True).alias("tail"))
    both = own.unionByName(tails).repartitionById(len(cuts) + 1, "bucket")  # one range, one task: no two meet by hash
    ordered = both.sortWithinPartitions("bucket", "tail", F.desc("key"), "text")
    return ordered.select("bucket", "tail", "doc_id", "text").mapInArrow(_run(n_samples), OUT)


def _bucket(edges: np.ndarray):
    """Column expression: in how many ranges, counted from the largest ids, a key lies behind the first.

    Two levels of about sqrt(n) edges each, so that a row costs few comparisons however many ranges there are.
    """
    step = max(1, int(len(edges) ** 0.5))
    parts = [edges[i : i + step].tolist() for i in range(0, len(edges), step)]
    below = lambda key, among: F.aggregate(among, F.lit(0), lambda n, e: n + (e < key).cast("int"))
    array = lambda xs: F.array(*[F.lit(int(x)) for x in xs])

    def search(key):
        part = below(key, array([p[-1] for p in parts]))  # parts that lie below the key altogether
        inner = F.get(F.array(*map(array, parts)), part)
        return F.lit(len(edges)) - part * step - F.coalesce(F.when(part < len(parts), below(key, inner)), F.lit(len(edges)) - part * step)

    return search
