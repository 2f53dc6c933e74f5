"""Graph of candidate links: build, components, best neighbours.

Clusters are connected components here (the original's own fallback) and communities by modularity in communities.py; betweenness
is computed there and thrown away, so it is not computed here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderflow.operators.scratch import scratch_dir


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the session's shared folder; sets one of our own only on one machine without it."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))


def bipartite_edges(pairs: DataFrame, threshold: float = 60.0) -> DataFrame:
    """Edges P_left - X_right of the pairs (left_id, right_id, score) with at least the threshold."""
    return pairs.where(F.col("score") >= threshold).select(
        F.concat(F.lit("P_"), F.col("left_id").cast("string")).alias("u"), F.concat(F.lit("X_"), F.col("right_id").cast("string")).alias("v"), F.col("score").alias("weight")
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component), the least id reachable. Each round takes the least label of neighbours and then that label's
    own label (pointer jumping), so long chains shorten by half; the lineage is cut by checkpoint()."""
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).distinct().checkpoint()
    labels = both.groupBy(F.col("u").alias("id")).agg(F.least("id", F.min("v")).alias("component")).checkpoint()
    for _ in range(rounds):
        near = both.join(labels, both["v"] == labels["id"]).groupBy("u").agg(F.min("component").alias("m"))
        lower = labels.join(near, labels["id"] == near["u"], "left").select("id", F.least("component", F.coalesce("m", "component")).alias("c"), F.col("component").alias("old"))
        own = lower.select(F.col("id").alias("c"), F.col("c").alias("jump"))
        after = lower.join(own, "c", "left").select("id", F.least("c", F.coalesce("jump", "c")).alias("component"), "old").checkpoint()
        changed = after.where("component <> old").limit(1).count()
        labels = after.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError(f"edges have no stable components after {rounds} rounds")


def best_neighbours(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """For each left node its best right node in the component (least name on ties), with the component's mean
    weight."""
    placed = edges.join(comps.withColumnRenamed("id", "u"), "u")
    means = placed.groupBy("component").agg(F.avg("weight").alias("cluster_confidence"))
    best = placed.groupBy("u", "component").agg(F.min_by(F.struct("v", "weight"), F.struct(-F.col("weight"), F.col("v"))).alias("b"))
    return best.join(means, "component").select("u", "component", F.col("b.v").alias("v"), F.col("b.weight").alias("weight"), "cluster_confidence")


def logistic_fit(rows: DataFrame, features: list[str], label: str, epochs: int = 200, rate: float = 0.1) -> tuple[list[float], float]:
    """Weights and bias of a logistic regression by full-batch descent from zero; each epoch is one aggregation, of
    which only the gradient (one number for each feature) comes to the driver. The rows are written once and read in each."""
    ensure_checkpoint_dir(rows.sparkSession)
    rows = rows.select(*features, label).checkpoint()
    n = rows.count()
    weights, bias = [0.0] * len(features), 0.0
    for _ in range(epochs if n else 0):
        z = F.lit(bias)
        for w, f in zip(weights, features, strict=True):
            z = z + F.lit(w) * F.col(f)
        error = 1 / (1 + F.exp(-z)) - F.col(label)
        g = rows.agg(*[F.sum(error * F.col(f)) for f in features], F.sum(error)).first()
        weights = [w - rate * x / n for w, x in zip(weights, g[:-1], strict=True)]
        bias -= rate * g[-1] / n
    return weights, bias
