"""Scratch folder of a session: the shared one that the cluster names, else, on one machine, one of our own."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only used on one machine, where driver and executors are one process.
OWN_SCRATCH = "/tmp/checkpoints"
_cleaned: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, also set as the checkpoint folder of the context. Without that setting a
    local session gets a folder of its own; on a cluster, whose executors would each write to their own disk, it is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = OWN_SCRATCH
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """The application's folder in scratch_dir(), deleted when the driver ends."""
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}"
    if path not in _cleaned:
        _cleaned.add(path)
        atexit.register(_delete, spark, path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the application's folder and read again: cuts lineage, survives lost executors."""
    path = f"{own_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the gateway may be gone
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
