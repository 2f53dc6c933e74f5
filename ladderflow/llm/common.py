"""What the operators of this subpackage share: table access, scratch tables, Arrow helpers.

Scratch data is written as Parquet below the folder named by ``spark.checkpoint.dir``, which every executor of a
cluster reaches. Tables that a returned DataFrame still reads are deleted when the driver ends, others as soon as possible.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderflow.operators.scratch import own_folder

#: Bytes in one Arrow batch: whole texts of any length pass through Python workers in bounded memory (a batch holds at least
#: one row). The number of rows in a batch stays the session's own.
BATCH_BYTES = "1m"


def prepare(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the corpus, by Spark's own reader."""
    prepare(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer input splits than cores (a small file) is dealt to all cores; others are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors, costs one write."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables of which everything that reads them has been written."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, row_bytes: int = 64, elements: str | None = None, limit: int = 32 << 20) -> DataFrame:
    """A written table, marked for broadcast if it is measured to be small; else it is joined by a shuffle.

    Its size is counted as row_bytes for each row and 12 bytes for each element of the named array column.
    """
    size = F.count("*") * row_bytes
    if elements:
        size = size + F.coalesce(F.sum(F.size(elements)), F.lit(0)) * 12
    return F.broadcast(df) if (df.agg(size).first()[0] or 0) <= limit else df


def attach(pairs: DataFrame, table: DataFrame, on: dict[str, str], columns: dict[str, str], counted: DataFrame | None = None, pairs_per_part: int = 2_000) -> DataFrame:
    """pairs with columns of table, joined on {column of pairs: column of table}; counted: the pairs as a written table, if
    these are not one.

    A row of table that more than pairs_per_part pairs ask for is copied to a part for each so many of them, so that no task
    gets all of its pairs.
    """
    keys, counted = list(on), pairs if counted is None else counted
    hot = counted.groupBy(*keys).agg(F.ceil(F.count("*") / pairs_per_part).cast("int").alias("parts")).where("parts > 1")
    hot = small(materialize(hot, "hot-keys"))
    part = F.coalesce(F.pmod(F.xxhash64(*counted.columns), F.col("parts").cast("bigint")).cast("int"), F.lit(0)).alias("part")
    dealt = pairs.join(hot, keys, "left").select(*pairs.columns, part)
    own = table.select(*(F.col(t).alias(p) for p, t in on.items()), *(F.col(t).alias(name) for name, t in columns.items()))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    own = own.join(hot, keys, "left").select(*keys, *columns, copies)
    return dealt.join(own, [*keys, "part"]).drop("part")


def whole_row(df: DataFrame) -> DataFrame:
    """All columns of df as the one column ``row``: working columns beside it clash with none of them."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow under one name, so that each operator reads alike."""
    return df.mapInArrow(fn, schema)


def texts(df: DataFrame, *keep: str | Column) -> DataFrame:
    """The kept columns and ``text`` with null read as the empty text; extra columns of df are pruned here."""
    return df.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch from sequences in the order of the schema."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def worker_cache(key: tuple, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task (a loaded vocabulary); made anew in a new worker.

    Only one is kept at a time, so that the workers of a session do not gather those of all its queries.
    """
    kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if key not in kept:
        for other in [k for k in kept if isinstance(k, tuple)]:
            del kept[other]
        kept[key] = make()
    return kept[key]
