"""Communities of a weighted graph by modularity: G02, as joins and group-bys.

Nodes move to the neighbouring community of largest gain, round by round; then each community becomes a node, and the same
goes on, until nothing is gained. All adjacency is symmetric (both directions of an edge, a node's own weight once), so that the
sums of a level are those of the one before.

Moves of one round may get into each other's way (two nodes that change places). A round moves about half of the nodes, by
a hash, and counts only if modularity rises; otherwise only moves that share no community are made, whose gains add up
exactly. So each round gains, and the rounds end. Ties go to the smaller label; the result has the least id of a community as its
name. At the end single nodes may move once more between the communities that were found.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderflow.operators.scratch import written

#: Gains below this share of the graph's weight are rounding.
LEAST_GAIN = 1e-12
#: A level ends when two rounds in a row raise modularity by less than this.
LEAST_RISE = 1e-4
#: Both directions of an edge count.
EDGES_OF_A_TASK = 100_000


def adjacency(edges: DataFrame) -> DataFrame:
    """(u, v, w) both ways of undirected edges (u, v, weight), repeated ones added up; a loop counts twice. Edges without an end, or
    of no positive weight, are left out."""
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND weight > 0").select("u", "v", F.col("weight").cast("double").alias("w"))
    both = e.where("u <> v").union(e.where("u <> v").select(F.col("v"), F.col("u"), "w")).union(e.where("u = v").select("u", "v", F.col("w") * 2))
    return both.groupBy("u", "v").agg(F.sum("w").alias("w"))


def modularity(adj: DataFrame, labels: DataFrame) -> float:
    """Newman's modularity of labels (id, c) over adjacency (u, v, w)."""
    a, b = labels.select(F.col("id").alias("u"), F.col("c").alias("cu")), labels.select(F.col("id").alias("v"), F.col("c").alias("cv"))
    by = adj.join(a, "u").join(b, "v").groupBy("cu").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("own"))
    row = by.agg(F.sum("tot"), F.sum("own"), F.sum(F.col("tot") * F.col("tot"))).first()
    return row[1] / row[0] - row[2] / row[0] ** 2 if row[0] else 0.0


def _dealt(adj: DataFrame, degrees: DataFrame, parts: int) -> DataFrame:
    """(u, v, w, k) of the edges of a level but loops, with the weight of all of u's edges, dealt and sorted by v once and kept: each round
    only nodes go to them."""
    edges = adj.where("u <> v").join(degrees.select(F.col("id").alias("u"), "k"), "u")
    return edges.repartition(parts, "v").sortWithinPartitions("v").persist(StorageLevel.MEMORY_AND_DISK)


def _state(edges: DataFrame, nodes: DataFrame, total: float, parts: int) -> DataFrame:
    """(id, k, loop, c, own, to, gain) of nodes (id, k, loop, c) and dealt edges as a written table: the weight of a node's edges within its
    community (a loop's too) and, if it gains by moving, where to and how much; gain is half of total times what modularity
    gains. Nodes take the weight of their community along, so edges are shuffled once; modularity and the next moves both follow from here."""
    placed = nodes.join(nodes.groupBy("c").agg(F.sum("k").alias("tot")), "c").select("id", "k", "loop", F.col("c").alias("to"), "tot")
    met = edges.join(placed.select(F.col("id").alias("v"), "to", "tot"), "v").select(F.col("u").alias("id"), "to", "w", "tot", "k", F.lit(None).cast("double").alias("loop"))
    stays = placed.select("id", "to", F.lit(0.0).alias("w"), "tot", "k", "loop")  # also without a neighbour in its own community
    near = met.union(stays).repartition(parts, "id").groupBy("id", "to").agg(F.sum("w").alias("near"), *(F.max(x).alias(x) for x in ("tot", "k", "loop")))
    own = F.col("loop").isNotNull()
    value = F.col("near") - F.col("k") * (F.col("tot") - F.when(own, F.col("k")).otherwise(0.0)) / total
    best = near.withColumn("value", value).groupBy("id").agg(
        F.max("k").alias("k"), F.max("loop").alias("loop"), F.max(F.when(own, F.col("to"))).alias("c"),
        F.min_by(F.struct("to", "value"), F.when(~own, F.struct(-F.col("value"), F.col("to")))).alias("b"), F.max(F.when(own, F.col("value"))).alias("stay"), F.max(F.when(own, F.col("near"))).alias("near"),
    )
    gain = F.when((F.col("b.to") != F.col("c")) & (F.col("b.value") - F.col("stay") > LEAST_GAIN * total), F.col("b.value") - F.col("stay"))
    rated = best.withColumn("gain", gain).withColumn("to", F.when(F.col("gain").isNotNull(), F.col("b.to")))
    return written(rated.select("id", "k", "loop", "c", (F.col("near") + F.col("loop")).alias("own"), "to", "gain"), "state")


def _rated(state: DataFrame) -> tuple[float, int]:
    """Modularity of the labels of a state, and how many nodes gain by moving."""
    by = state.groupBy("c").agg(F.sum("k").alias("tot"), F.sum("own").alias("own"), F.count("gain").alias("n"))
    row = by.agg(F.sum("tot"), F.sum("own"), F.sum(F.col("tot") * F.col("tot")), F.sum("n")).first()
    return (row[1] / row[0] - row[2] / row[0] ** 2 if row[0] else 0.0), row[3] or 0


def _apart(moves: DataFrame) -> DataFrame:
    """Moves of which no two touch one community: those that are the best for both communities that they touch."""
    touched = moves.select("id", "gain", F.explode(F.array("c", "to")).alias("x"))
    first = touched.groupBy("x").agg(F.min_by("id", F.struct(-F.col("gain"), F.col("id"))).alias("first"))
    for side in ("c", "to"):
        moves = moves.join(first.select(F.col("x").alias(side), F.col("first").alias(f"first_{side}")), side)
    return moves.where("first_c = id AND first_to = id").select("id", "c", "to", "gain")


def local_moving(adj: DataFrame, labels: DataFrame, total: float, rounds: int = 500, least_rise: float = LEAST_RISE) -> tuple[DataFrame, float, bool]:
    """(labels, modularity, whether anything moved): rounds of moves until no node gains, or two rounds in a row gain little."""
    loop = F.sum(F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(0.0))
    degrees = written(adj.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k"), loop.alias("loop")), "degrees")
    parts = 1 + adj.count() // EDGES_OF_A_TASK
    edges = _dealt(adj, degrees, parts)
    try:
        return _rounds(edges, degrees.join(labels, "id"), total, parts, rounds, least_rise)
    finally:
        edges.unpersist()


def _rounds(edges: DataFrame, nodes: DataFrame, total: float, parts: int, rounds: int, least_rise: float) -> tuple[DataFrame, float, bool]:
    state = _state(edges, nodes, total, parts)
    (q, moves), moved, slow = _rated(state), False, 0
    for n in range(rounds):
        if not moves:
            return state.select("id", "c"), q, moved
        half = F.pmod(F.xxhash64("id", F.lit(n)), F.lit(2)) == 0
        for some in (True, False):
            to = state.withColumn("to", F.when(half, F.col("to"))) if some else state.drop("to").join(_apart(state.where("gain IS NOT NULL")).select("id", "to"), "id", "left")
            new = _state(edges, to.select("id", "k", "loop", F.coalesce("to", "c").alias("c")), total, parts)
            found, found_moves = _rated(new)
            if found > q:
                slow = slow + 1 if found - q < least_rise else 0
                state, q, moves, moved = new, found, found_moves, True
                break
        else:
            return state.select("id", "c"), q, moved  # what is left to gain is rounding
        if slow == 2:
            return state.select("id", "c"), q, moved
    raise RuntimeError(f"nodes still move after {rounds} rounds")


def _numbered(adj: DataFrame) -> DataFrame:
    """(id, n) of all nodes of an adjacency, numbered from 0 in the order of their ids: numbers are shuffled and compared in their place."""
    rows = written(adj.select(F.col("u").alias("id")).distinct().orderBy("id").withColumn("m", F.monotonically_increasing_id()), "ids")
    share = F.shiftright("m", 33)  # the task that wrote the row; tasks follow the order of ids
    before = Window.orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(share.alias("share")).agg(F.count("*").alias("rows")).select("share", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))  # a row for each task
    return rows.withColumn("share", share).join(F.broadcast(starts), "share").select("id", (F.col("start") + F.col("m") - F.shiftleft("share", 33)).alias("n"))


def communities(edges: DataFrame, levels: int = 50) -> tuple[DataFrame, float]:
    """(id, community) of every node of the edges (u, v, weight), and the modularity."""
    named = written(adjacency(edges), "named")
    ids = written(_numbered(named), "numbered")
    to = lambda x: ids.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"))
    whole = written(named.join(to("u"), "u").join(to("v"), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"), "w"), "adjacency")
    total = whole.agg(F.sum("w")).first()[0] or 0.0
    labels = ids.select(F.col("n").alias("id"), F.col("n").alias("c"))
    for _ in range(levels):
        labels, q, moved = local_moving(whole, labels, total)  # single nodes, also between communities that were merged
        merged = False
        while True:
            names = [labels.select(F.col("id").alias(x), F.col("c").alias(f"c{x}")) for x in "uv"]
            small = written(whole.join(names[0], "u").join(names[1], "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), "adjacency")
            own = small.select(F.col("u").alias("id"), F.col("u").alias("c")).distinct()
            own, q, went = local_moving(small, own, total)
            if not went:
                break
            merged = True
            labels = written(labels.withColumnRenamed("c", "old").join(own.select(F.col("id").alias("old"), "c"), "old").select("id", "c"), "labels")
        if not merged:
            break
    least = labels.join(labels.groupBy("c").agg(F.min("id").alias("least")), "c")
    both = least.join(ids.select(F.col("n").alias("least"), F.col("id").alias("community")), "least").select(F.col("id").alias("n"), "community")
    return both.join(ids, "n").select("id", "community"), q
