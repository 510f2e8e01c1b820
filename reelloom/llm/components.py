"""Connected components of a graph in a DataFrame, by large-star and small-star steps.

Each step replaces edges by edges to the least neighbour; the edge set only shrinks or is rewired,
and after few steps every node hangs on the least node of its component. Steps are joins and
aggregations; a node with many neighbours is pre-aggregated and its least one broadcast to its
edges. Each step's edges are kept in the shared folder, so a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_count


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        arcs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        arcs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = cut(arcs.groupBy("a").agg(F.least("a", F.min("b")).alias("low"), F.count("*").alias("n")))
    rows = least.agg(F.sum("n")).first()[0] or 0
    joined = join_by_count(arcs, least, ["a"], "n", rows)
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    return moved.filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) of every node in edges (a, b), of one ordered type."""
    now = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        now = cut(_star(cut(_star(now, large=True)), large=False))
        after = _state(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"no fixed point in {rounds} rounds")
    hung = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return hung.unionByName(tops)
