"""A stream's sink that loses nothing and doubles nothing: T15, K08.

Each micro-batch is written to a folder of its own attempt, and then named in a manifest, whose rename is the last step. Who
reads follows the manifests: files of an attempt that broke off are in none. A batch that is given again (a failure behind
the rename and before the checkpoint) finds its manifest and writes nothing. Every ``compact_every`` batches a manifest names
all batches so far, so readers open few files.

The folder must be on a file system with an atomic rename of files (HDFS and its like), shared by driver and executors.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTRY = "batch long, path string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Manifests:
    """The manifests below root, by Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str, compact_every: int = 50):
        self.spark, self.root, self.compact_every = spark, root, compact_every
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def file(self, batch: int) -> str:
        whole = batch % self.compact_every == self.compact_every - 1
        return f"{self.root}/manifest/{batch:012d}{'.all' if whole else ''}.json"

    def has(self, batch: int) -> bool:
        return self.fs.exists(self.path(self.file(batch)))

    def files(self) -> list[str]:
        """The manifests to read: the last one that names all batches, and those behind it."""
        folder = self.path(f"{self.root}/manifest")
        found = sorted(s.getPath().getName() for s in self.fs.listStatus(folder)) if self.fs.exists(folder) else []
        found = [n for n in found if n.endswith(".json") and not n.startswith((".", "_"))]
        last = max((i for i, n in enumerate(found) if n.endswith(".all.json")), default=0)
        return [f"{self.root}/manifest/{n}" for n in found[last:]]

    def entries(self) -> list[dict]:
        """Committed batches and their folders: one row for each batch."""
        files = self.files()
        return [r.asDict() for r in self.spark.read.schema(ENTRY).json(files).orderBy("batch").collect()] if files else []

    def commit(self, batch: int, path: str) -> None:
        """Names a batch's folder; the rename is the commit."""
        rows = [{"batch": batch, "path": path}]
        if self.file(batch).endswith(".all.json"):
            rows = [*self.entries(), *rows]
        temporary = self.path(f"{self.root}/manifest/_{batch}-{uuid.uuid4().hex}")
        out = self.fs.create(temporary, True)
        out.write(bytearray("\n".join(map(json.dumps, rows)).encode()))
        out.close()
        if not self.fs.rename(temporary, self.path(self.file(batch))):
            raise OSError(f"the manifest of batch {batch} could not be renamed")


def read_committed(spark: SparkSession, root: str, schema: StructType | str, mode: str = "append") -> DataFrame:
    """The rows of all committed batches; in complete mode those of the last one."""
    entries = Manifests(spark, root).entries()
    if mode == "complete":
        entries = entries[-1:]
    empty = spark.createDataFrame([], schema)
    if not entries:
        return empty
    rows = spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*(e["path"] for e in entries))
    return rows.select(*(F.col(f"`{c}`") for c in empty.columns))


def run_committed(
    stream: DataFrame, root: str, mode: str = "append", subscribers: list[Callable[[DataFrame, int], None]] = (), partition_by: list[str] = (), attempts: int = 1, first_wait: float = 1.0, longest_wait: float = 60.0,
    compact_every: int = 50, before_commit: Callable[[int], None] | None = None, after_commit: Callable[[int], None] | None = None,
) -> DataFrame:
    """Runs a stream over all that is there and returns the committed rows. A run that fails is started again from its
    checkpoint, after a random wait that doubles up to the longest, so many attempts in all; run again on the same root, it
    goes on. Subscribers get each batch and its number before it is committed, and may get a batch again after a failure.
    State is kept in RocksDB. before_commit and after_commit serve tests of failures."""
    spark = stream.sparkSession
    manifests, schema = Manifests(spark, root, compact_every), stream.schema

    def write(batch: DataFrame, number: int) -> None:
        if manifests.has(number):
            return
        path = f"{root}/data/batch={number}/attempt=a{uuid.uuid4().hex}"
        batch.write.partitionBy(*partition_by).parquet(path)
        kept = spark.read.schema(schema).option("basePath", path).parquet(path)
        for subscriber in subscribers:
            subscriber(kept, number)
        if before_commit:
            before_commit(number)
        manifests.commit(number, path)
        if after_commit:
            after_commit(number)

    kept_provider = spark.conf.get(PROVIDER)
    for n in range(attempts):
        try:
            spark.conf.set(PROVIDER, ROCKSDB)
            try:
                query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
            finally:
                spark.conf.set(PROVIDER, kept_provider)
            query.awaitTermination()
            break
        except StreamingQueryException:
            if n == attempts - 1:
                raise
            time.sleep(random.random() * min(longest_wait, first_wait * 2**n))
    return read_committed(spark, root, schema, mode)
