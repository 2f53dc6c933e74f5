"""Product codes of vectors: weighted Lloyd over distinct integer parts.

Vectors are cut into equal parts. Equal integer parts of one position become one row with a weight, so a round of Lloyd's
algorithm touches each distinct part once, however many vectors hold it. A round sends the codebooks (``entries`` times
the dimension: bounded) to the tasks; each task returns weighted sums for each entry alone. The final codes and errors are
joined back to the vectors on the part; a part that many vectors share is copied behind a salt first.

All arithmetic is on integers: float64 where that is exact, Python's integers beyond; a sum, error or component that no
64-bit integer holds is an error, never a wrong number.

Defined results: vectors that are null or hold null or non-finite components take no part. Shorter vectors, the empty one
too, count as filled up with zeros to the longest, and that to a multiple of ``parts``. Every other row counts, also rows
that repeat a vec_id (first entries: ties by the vector) and rows without vec_id (behind all others). Fewer rows than
entries give a shorter codebook. Null labels are one label. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderflow.llm.common import discard, materialize, small
from ladderflow.llm.vectors import finite_vectors, matrix

#: Integers below this are exact in float64.
EXACT = float(1 << 53)


def integer_rows(df: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v array<bigint>: floor(scale * x) of each component of each finite vector."""
    too_large = F.raise_error(F.lit("a component is too large for a 64-bit integer")).cast("bigint")
    whole = F.transform("x", lambda e: F.when(F.abs(e * scale) < 2.0**63, F.floor(e * scale).cast("bigint")).otherwise(too_large))
    return finite_vectors(df, "vec_id", "label").select("vec_id", "label", whole.alias("v"))


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to entries: float64 where that is exact, else Python's integers."""
    most = float(np.abs(x.astype(np.float64)).max(initial=0) + np.abs(entries.astype(np.float64)).max(initial=0))
    if x.shape[1] * most * most < EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]
    a, b = x.astype(object), entries.astype(object)
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(2)


def nearest(position: np.ndarray, x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The nearest entry (ties: the lower index) of each part in the codebook of its position, and the squared distance."""
    code, error = np.zeros(len(x), np.int64), [0] * len(x)
    for p in np.unique(position):
        at = np.flatnonzero(position == p)
        d = squares(x[at], books[p])
        code[at] = d.argmin(1)
        for i, e in zip(at.tolist(), d[np.arange(len(at)), code[at]].tolist(), strict=True):
            error[i] = int(e)
    return code, error


def _batch(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return b.column("pos").to_numpy(), matrix(b.column("part"), width, np.int64)


def lloyd_round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over the weighted distinct parts; entries without parts stay."""
    n_parts, n_entries, width = books.shape

    def sums(batches):
        count = np.zeros((n_parts, n_entries), object)
        total = np.zeros((n_parts, n_entries, width), object)
        for b in batches:
            pos, x = _batch(b, width)
            n = b.column("n").to_numpy()
            code, _ = nearest(pos, x, books)
            small_sums = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(n.sum()) < EXACT
            own = np.zeros((n_parts, n_entries, width), np.float64 if small_sums else object)
            np.add.at(own, (pos, code), x * n[:, None] if small_sums else x.astype(object) * n.astype(object)[:, None])
            total += own.astype(np.int64).astype(object) if small_sums else own
            weight = np.zeros((n_parts, n_entries), np.int64)
            np.add.at(weight, (pos, code), n)
            count += weight
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e].tolist(), pa.int64()), pa.array([r.tolist() for r in total[p, e]], pa.list_(pa.int64()))], names=["pos", "entry", "n", "sums"]
        )

    partial = distinct.mapInArrow(sums, "pos int, entry int, n long, sums array<long>")
    merged = partial.groupBy("pos", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)))
    out = books.copy()
    for r in merged.collect():  # at most one row for each entry
        out[r["pos"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], total: int, row_id: str = "rid") -> DataFrame:
    """rows with the columns of table, which has one row for each key and in ``n`` the number of rows that hold it.

    A key of more than a thousandth of all rows (at most 1,000 keys for each row that ``total`` counts once) is dealt out:
    table's row is copied and rows go to a copy by the hash of row_id. The list of such keys is bounded, so it is broadcast.
    """
    each = max(2_000, -(-total // 1_000))
    hot = F.broadcast(table.where(F.col("n") > each).select(*keys, F.ceil(F.col("n") / each).cast("bigint").alias("copies")))
    salt = F.pmod(F.xxhash64(row_id), F.coalesce("copies", F.lit(1).cast("bigint"))).cast("int")
    left = rows.join(hot, keys, "left").withColumn("salt", salt).drop("copies")
    upto = F.greatest(F.ceil(F.col("n") / each).cast("int"), F.lit(1)) - 1
    return left.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), upto))).drop("n"), [*keys, "salt"]).drop("salt")


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row of integer_rows(): see the module."""
    spark = vectors.sparkSession
    numbered = vectors.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "v")
    rows = materialize(numbered, "codes-vectors")  # written, so that a row keeps its number
    n_rows, longest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n_rows:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width = -(-longest // parts)
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width * parts) - F.size("v")))
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(F.col("filled"), i * width + 1, F.lit(width)))
    pieces = rows.withColumn("filled", filled).select("rid", "vec_id", "label", F.posexplode(cut).alias("pos", "part"))
    distinct = materialize(pieces.groupBy("pos", "part").agg(F.count("*").alias("n")), "codes-parts")

    first = rows.withColumn("filled", filled).orderBy(F.asc_nulls_last("vec_id"), "filled").limit(entries).select("filled").collect()
    books = np.array([list(r["filled"]) for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = lloyd_round(distinct, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def final(batches):
        for b in batches:
            code, error = nearest(*_batch(b, width), books)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code.astype(np.int32)), pa.array(error, pa.int64())], names=[*b.schema.names, "code", "error"])

    coded = distinct.mapInArrow(final, "pos int, part array<long>, n long, code int, error long")
    coded = materialize(coded, "codes-coded")
    each = join_counted(pieces, coded, ["pos", "part"], n_rows)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda s: F.lower(F.lpad(F.hex(s["code"]), 2, "0")))
    whole = each.groupBy("rid", "vec_id", "label").agg(F.concat_ws("", in_order).alias("code"), F.sum("error").alias("error"))
    key = F.struct(F.col("label").isNull(), F.coalesce(F.col("label").cast("string"), F.lit(""))).cast("string").alias("label_key")
    whole = materialize(whole.select("rid", "vec_id", "code", "error", key), "codes-rows")
    discard(rows, distinct, coded)
    by_label = materialize(whole.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "codes-labels")
    sums = small(by_label)
    out = whole.join(sums.drop("n"), "label_key") if sums is not by_label else join_counted(whole, by_label, ["label_key"], n_rows)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assigned(name: str, books: str) -> str:
    """DuckDB: the best entry of each part, as distance * 64 + entry."""
    return f"""{name} AS (SELECT p.rn, p.pos, any_value(p.part) AS part, min(CAST(list_sum(list_transform(range(1, len(p.part) + 1), lambda i: (p.part[i] - c.c[i]) * (p.part[i] - c.c[i]))) AS BIGINT) * 64 + c.e) AS best
 FROM p JOIN {books} c ON c.pos = p.pos GROUP BY p.rn, p.pos)"""


def _moved(name: str, assigned: str, books: str) -> str:
    return f"""{name}_s AS (SELECT pos, best % 64 AS e, i, CAST(floor(sum(part[i]) / count(*)) AS BIGINT) AS m FROM {assigned}, range(1, len({assigned}.part) + 1) r(i) GROUP BY ALL),
{name}_m AS (SELECT pos, e, list(m ORDER BY i) AS c FROM {name}_s GROUP BY ALL),
{name} AS (SELECT b.pos, b.e, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN {name}_m m ON m.pos = b.pos AND m.e = b.e)"""


#: DuckDB SQL for the registered query.
ORACLE = f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS rn, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
 FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT rn, pos, v[pos * (len(v) // 16) + 1 : (pos + 1) * (len(v) // 16)] AS part FROM k, range(16) r(pos)),
c0 AS (SELECT pos, rn - 1 AS e, part AS c FROM p WHERE rn <= 64),
{_assigned("a0", "c0")}, {_moved("c1", "a0", "c0")}, {_assigned("a1", "c1")}, {_moved("c2", "a1", "c1")}, {_assigned("a2", "c2")},
o AS (SELECT rn, string_agg(format('{{:02x}}', best % 64), '' ORDER BY pos) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY rn),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN k USING (rn), h"""
