"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.session import cut_lineage

#: Edges that a task of a step gets before another task is added.
TASK_EDGES = 10_000


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """One row ``(node, component)`` for every node that has an edge; component is its smallest node.

    Edges are undirected; loops, repeats and edges with a null end are allowed and add nothing.
    Every step sends each node's neighbours to the smallest of them, so the edges turn into one
    star per component within a number of rounds logarithmic in the longest path.  Minima are
    aggregated map-side and checkpointed before they are joined, so the join reads two plain
    exchanges and Spark may split a hub that has very many neighbours.  The edges never get more, so
    their first count says how many tasks a step needs: every task leaves files of its own in each of
    a step's exchanges and checkpoints, and few edges over many partitions were mostly files.
    """
    a, b = F.col(left), F.col(right)
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    state = cut_lineage(pairs.where(F.col("u") > F.col("v")).distinct())
    before, tasks = None, None
    while True:
        mark = _mark(state)
        tasks = tasks or -(-mark[0] // TASK_EDGES)
        if mark == before or mark[0] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = mark
        state = _small_star(_large_star(state.coalesce(tasks), tasks), tasks)


def _mark(state: DataFrame) -> tuple:
    """Equal marks mean equal edge sets: count, and two sums over the edges' hashes.

    Summed as decimals: 40-bit hashes pass a bigint at about 2^24 edges.
    """
    h = F.xxhash64("u", "v")
    row = state.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(h.bitwiseAND((1 << 40) - 1).cast("decimal(20,0)")).alias("low"),
        F.sum(F.shiftrightunsigned(h, 32).cast("decimal(20,0)")).alias("high"),
    ).first()
    return tuple(row)


def _large_star(state: DataFrame, tasks: int) -> DataFrame:
    """Larger neighbours of every node move to the smallest node of its neighbourhood."""
    both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks))
    moved = both.join(least, "u").where(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct()


def _small_star(state: DataFrame, tasks: int) -> DataFrame:
    """Smaller neighbours of every node, and the node itself, move to the smallest of them."""
    state = cut_lineage(state.coalesce(tasks))
    least = cut_lineage(state.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))
    moved = state.join(least, "u").where(F.col("v") > F.col("m"))
    return cut_lineage(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    ).coalesce(tasks).distinct().coalesce(tasks))
