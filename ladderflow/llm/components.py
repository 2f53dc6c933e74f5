"""Connected components of a graph of links, by alternating large-star and small-star steps.

Every step is a group-by and a join; nothing but two numbers a round comes to the driver, and each round is written to
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderflow.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above u is linked to the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its neighbours below it are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """id, component (least id reachable) of every id that has a link to another; links: u, v. The number of rounds grows
    with the logarithm of the links, so the limit is never met; if it were, that is an error and not a result."""
    edges = materialize(links.where("u <> v").select("u", "v").distinct(), "cc-links")
    mark = None
    for _ in range(rounds):
        before, edges = edges, materialize(_small_star(_large_star(edges)).where("u <> v").distinct(), "cc-round")
        discard(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"links have no stable components after {rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
