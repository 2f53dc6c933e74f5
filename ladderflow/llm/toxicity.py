"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where x_i says whether hashed term i is in the text. The
pairwise part learns what additive weights miss, such as an insult together with the mention of a group.

Terms are a text's lower-cased words, and for longer words their first three to six letters, which stand for inflected
and compound forms. Terms are hashed into ``n_buckets``. The model keeps weights for the buckets that tell the labels apart alone
(chi-square above 6.63, in at least ``min_rows`` training rows), and for those that do so in pairs, however little each of
them says alone: of all pairs of buckets that at least ``min_share`` of the training rows hold, those whose effect together
differs from the sum of their own effects (a contrast of the four cells, of at least 20 rows each; a stronger one if one of the two
is kept anyway, since a plain word beside a toxic one differs by language alone). How many are kept has no limit but the number of
buckets.

The model is fitted on the driver on at most ``max_rows`` labelled rows, chosen by the hash of doc_id; this bound is the
only sample. Everything else covers all rows. Scores come from the text alone.

Defined results: null text is the empty text and gets the score of the bias. Rows without labels are scored like all
others; null labels do not train, and of conflicting labels of one doc_id the larger counts. With no training rows every
score is that of a bias of -40, below 1e-17. Repeated rows give repeated results; a null doc_id is kept and not held out;
equal scores need no order; extra columns of any name are kept by keep_clean() and ignored by predictions().
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ladderflow.llm.common import materialize, texts, worker_cache

WORD = re.compile(r"\w+")


class Terms:
    """Hashed terms of texts; keeps the terms of words that it has met."""

    def __init__(self, n_buckets: int, prefixes: tuple[int, ...] = (3, 4, 5, 6), cache_words: int = 120_000):
        self.n_buckets, self.prefixes, self.limit = n_buckets, prefixes, cache_words
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        parts = [b"w" + word.encode("utf-8", "surrogatepass")]
        parts += [b"p" + word[:k].encode("utf-8", "surrogatepass") for k in self.prefixes if k < len(word)]
        return tuple(zlib.crc32(p) % self.n_buckets for p in parts)

    def of(self, text: str) -> np.ndarray:
        """Distinct buckets of a whole text, sorted."""
        words = set(WORD.findall(text.lower()))
        if len(self.known) > self.limit:
            self.known = {}
        known, out = self.known, set()
        for w in words:
            terms = known.get(w)
            if terms is None:
                terms = known[w] = self._of(w)
            out.update(terms)
        return np.array(sorted(out), np.int64)


@dataclass
class Model:
    """bias, weight of each kept bucket, factors of each kept bucket; slot: bucket -> row, -1 if not kept."""

    bias: float
    weight: np.ndarray
    factors: np.ndarray
    slot: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores of texts by their terms: sums over all kept terms of a batch at once."""
        slots = self.slot[np.concatenate(rows)] if rows else np.empty(0, np.int32)
        own = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[slots >= 0]
        slots = slots[slots >= 0]
        add = lambda x: np.bincount(own, x, len(rows))
        z = self.bias + add(self.weight[slots])
        for v in self.factors[slots].T:
            z += 0.5 * (add(v) ** 2 - add(v**2))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score(self, terms: np.ndarray) -> float:
        """The score of one text."""
        return float(self.scores([terms])[0])


def choose(seen: np.ndarray, seen1: np.ndarray, n: int, n1: int, min_rows: int = 4) -> np.ndarray:
    """The buckets that tell the labels apart alone; seen, seen1: training rows, and toxic ones, that have each bucket."""
    seen, seen1 = seen.astype(float), seen1.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = seen1 * (n - n1 - (seen - seen1)) - (n1 - seen1) * (seen - seen1)
        chi = np.where(seen >= min_rows, n * gap**2 / (seen * (n - seen) * n1 * (n - n1)), 0.0)
    return np.flatnonzero(np.nan_to_num(chi) > 6.63)


def choose_pairs(
    rows: list[np.ndarray], label: np.ndarray, buckets: np.ndarray, n_buckets: int, alone: np.ndarray | None = None, least: float = 30.0, least_beside: float = 1_000.0, min_cell: int = 20, block: int = 128, chunk: int = 1_024
) -> np.ndarray:
    """Those of the buckets that tell the labels apart together with another one: where the share of toxic rows among rows with
    both, one, the other and none (p11 - p10 - p01 + p00, squared over its variance) is above least, or above least_beside if one of
    the two is in alone. rows: buckets of each row. Memory: a byte for each row and bucket, and some arrays of block times buckets."""
    width = len(buckets)
    slot = np.full(n_buckets, -1, np.int32)
    slot[buckets] = np.arange(width)
    x = np.zeros((len(rows), width), np.int8)
    for i, r in enumerate(rows):
        at = slot[r]
        x[i, at[at >= 0]] = 1
    y = np.asarray(label, bool)
    n, n1 = len(y), int(y.sum())
    own, own1 = x.sum(0, dtype=np.int64).astype(float), x[y].sum(0, dtype=np.int64).astype(float)
    found = np.zeros(width, bool)
    kept = np.isin(buckets, alone if alone is not None else [])
    for b in range(0, width, block):
        both, both1 = (np.zeros((min(block, width - b), width)) for _ in range(2))
        for i in range(0, n, chunk):
            part, toxic = x[i : i + chunk].astype(np.float32), y[i : i + chunk]
            both += part[:, b : b + block].T @ part
            both1 += part[toxic, b : b + block].T @ part[toxic]
        a, a1 = own[b : b + block, None], own1[b : b + block, None]
        cells = [(both, both1), (a - both, a1 - both1), (own[None, :] - both, own1[None, :] - both1), (n - a - own[None, :] + both, n1 - a1 - own1[None, :] + both1)]
        shares = [(t + 0.5) / (m + 1) for m, t in cells]
        gap = shares[0] - shares[1] - shares[2] + shares[3]
        noise = sum(p * (1 - p) / (m + 1) for p, (m, _) in zip(shares, cells, strict=True))
        bound = np.where(kept[b : b + block, None] | kept[None, :], least_beside, least)
        good = (gap**2 > bound * noise) & np.logical_and.reduce([m >= min_cell for m, _ in cells])
        found[b : b + block] |= good.any(1)
        found |= good.any(0)
    return buckets[found]


def constant(share: float, n_buckets: int, n_factors: int = 4) -> Model:
    """The model of rows that all have one label, or of no rows."""
    bias = 40.0 if share == 1 else -40.0
    return Model(bias, np.zeros(0), np.zeros((0, n_factors)), np.full(n_buckets, -1, np.int32))


def fit(rows: list[np.ndarray], label: np.ndarray, kept: np.ndarray, n_buckets: int, n_factors: int = 4, epochs: int = 60, rate: float = 0.05, l2: float = 2e-4, seed: int = 7) -> Model:
    """Adam on the log loss, in shuffled batches. rows: the kept buckets of each training row; both labels occur."""
    y = np.asarray(label, float)
    slot = np.full(n_buckets, -1, np.int32)
    slot[kept] = np.arange(len(kept))
    begin = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    local = slot[np.concatenate(rows)] if begin[-1] else np.zeros(0, np.int32)
    n, n1 = len(y), y.sum()
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(len(kept)), rng.normal(0, 0.02, (len(kept), n_factors)), float(np.log(n1 / (n - n1)))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v), 0.0, 0.0]
    by_slot = lambda at, x, size: np.stack([np.bincount(at, x[:, k], size) for k in range(x.shape[1])], 1)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 512):
            part = order[i : i + 512]
            counts = begin[part + 1] - begin[part]
            at = np.repeat(begin[part] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            ids, own = local[at], np.repeat(np.arange(len(part)), counts)
            mine = v[ids]
            total = by_slot(own, mine, len(part))
            square = np.bincount(own, (mine**2).sum(1), len(part))
            z = b + np.bincount(own, w[ids], len(part)) + 0.5 * ((total**2).sum(1) - square)
            error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part]
            gw = np.bincount(ids, error[own], len(w)) / len(part) + l2 * w
            gv = by_slot(ids, error[own, None] * (total[own] - mine), len(w)) / len(part) + l2 * v
            gb = error.mean()
            step += 1
            for k, (value, g) in enumerate(((w, gw), (v, gv))):
                m, s = moments[2 * k], moments[2 * k + 1]
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            b -= rate * gb
    return Model(b, w, v, slot)


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2 never train. A null doc_id is not held out, and has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, n_buckets: int = 1 << 18, max_rows: int = 20_000, min_share: float = 0.2) -> Model:
    """Fits the model on at most max_rows labelled rows that are not held out. To the driver come a count for each bucket
    and, of each training row, only the buckets that may be kept."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # its size is bounded: it may be broadcast
    sample = texts(docs, "doc_id").join(F.broadcast(chosen), "doc_id")

    def terms(batches):
        hashed = Terms(n_buckets)
        for b in batches:
            rows = [hashed.of(t).astype(np.int32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms"])

    found = sample.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(terms, "doc_id long, toxic int, terms array<int>")
    found = materialize(found, "toxicity-sample")

    def counted(batches):
        seen = np.zeros((2, n_buckets), np.int64)
        for b in batches:
            for toxic, row in zip(b.column("toxic").to_pylist(), b.column("terms"), strict=True):
                seen[int(toxic > 0), row.values.to_numpy()] += 1
        at = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["bucket", "clean", "toxic"])

    n, n1 = found.agg(F.count("*"), F.sum((F.col("toxic") > 0).cast("int"))).first()
    if not n or n1 in (0, n):
        return constant(n1 / n if n else 0.0, n_buckets)
    stats = found.select("toxic", "terms").mapInArrow(counted, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    seen = np.zeros((2, n_buckets), np.int64)
    seen[:, stats["bucket"]] = stats[["clean", "toxic"]].to_numpy().T
    alone, frequent = choose(seen.sum(0), seen[1], n, n1), np.flatnonzero((seen.sum(0) >= min_share * n) & (seen.sum(0) <= (1 - min_share) * n))
    is_kept = np.zeros(n_buckets, bool)
    is_kept[alone] = is_kept[frequent] = True

    def only_kept(batches):
        for b in batches:
            rows = [x[is_kept[x]] for x in (row.values.to_numpy() for row in b.column("terms"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms"])

    table = found.mapInArrow(only_kept, "doc_id long, toxic int, terms array<int>").toArrow().sort_by("doc_id").combine_chunks()
    toxic = table.column("toxic").to_numpy() > 0
    terms_of = table.column("terms").combine_chunks()
    begin, flat = terms_of.offsets.to_numpy(), terms_of.values.to_numpy()
    rows = [flat[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]  # views of one array
    kept = np.union1d(alone, choose_pairs(rows, toxic, frequent, n_buckets, alone))
    is_kept[:] = False
    is_kept[kept] = True
    return fit([r[is_kept[r]] for r in rows], toxic, kept, n_buckets)


def score(docs: DataFrame, model: Model, *keep: str, threshold: float = 0.3, n_buckets: int = 1 << 18) -> DataFrame:
    """row (the kept columns of docs, a struct that no name clashes with), score and predicted of every text."""
    source = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    fields = StructType([source.schema["row"], StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches):
        hashed = worker_cache(("terms", n_buckets), lambda: Terms(n_buckets))
        for b in batches:
            s = model.scores([hashed.of(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["row", "score", "predicted"])

    return source.mapInArrow(run, fields)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels)
    return score(docs, model, "doc_id").select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, whose prediction is not toxic.

    The decision is made on the text alone.
    """
    return score(docs, train(docs, labels), *docs.columns).where("predicted = 0").select("row.*")
