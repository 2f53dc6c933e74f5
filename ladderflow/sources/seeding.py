"""Seeding of aliases league by league, with a log of what is done: S31, S32.

Leagues are fetched in chunks. A chunk's alias rows and the names of its leagues are written below one folder of the attempt, and
one manifest, renamed last, commits both: a league is done exactly if its rows are there. A run that breaks off leaves files that no
manifest names; the next run skips the leagues that are done and goes on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderflow.streaming.committed import Manifests

ALIASES = "league string, canonical string, alias string"


def alias_rows(entities: DataFrame) -> DataFrame:
    """league, canonical, alias of entities (league, name, code): the name and the code, once each; a missing one is none."""
    return entities.where("name IS NOT NULL").select(F.col("league").cast("string").alias("league"), F.col("name").alias("canonical"), F.explode(F.array_distinct(F.array_compact(F.array("name", "code")))).alias("alias")).distinct()


def _folders(spark: SparkSession, root: str, kind: str) -> list[str]:
    return [f"{e['path']}/{kind}" for e in Manifests(spark, root).entries()]


def done_leagues(spark: SparkSession, root: str) -> DataFrame:
    """The leagues that are seeded, also those without any entity."""
    folders = _folders(spark, root, "done")
    return spark.read.schema("league string").parquet(*folders) if folders else spark.createDataFrame([], "league string")


def seeded(spark: SparkSession, root: str) -> DataFrame:
    """The alias rows of all leagues that are done."""
    folders = _folders(spark, root, "aliases")
    return spark.read.schema(ALIASES).parquet(*folders) if folders else spark.createDataFrame([], ALIASES)


def seed(spark: SparkSession, leagues: DataFrame, fetch: Callable[[DataFrame], DataFrame], root: str, chunk: int = 100) -> DataFrame:
    """Seeds the leagues (league) that are not done and returns all alias rows. fetch gives the entities (league, name, code) of a
    table of leagues; its failure ends the run, and what was committed stays. Chunks are numbered on from the log, and leagues are
    dealt to them by rank, so no list of leagues comes to the driver."""
    wanted = leagues.select(F.col("league").cast("string").alias("league")).where("league IS NOT NULL").distinct()
    rest = wanted.join(done_leagues(spark, root), "league", "left_anti")
    path = f"{root}/open/{uuid.uuid4().hex}"
    n = rest.count()
    parts = -(-n // chunk)
    rest.withColumn("part", F.pmod(F.xxhash64("league"), F.lit(max(parts, 1)))).write.partitionBy("part").parquet(path)
    dealt = spark.read.schema("league string, part long").parquet(path)
    for i in range(parts):
        some = dealt.where(F.col("part") == i).select("league")
        if some.isEmpty():
            continue
        attempt = f"{root}/data/{uuid.uuid4().hex}"
        alias_rows(fetch(some)).write.parquet(f"{attempt}/aliases")
        some.write.parquet(f"{attempt}/done")
        log = Manifests(spark, root)
        log.commit(len(log.entries()), attempt)
    return seeded(spark, root)
