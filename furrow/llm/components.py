"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.frames import stored

#: Stored edges are read by a task for each so many, not by one for each of the files that a round left.
TASK_EDGES = 100_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them and itself: those above it (large) or those below it and itself (small)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    seen = both.join(least, "u")
    if large:
        out = seen.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = seen.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node in an edge (u, v): root is the least node that it reaches. Nodes are longs.

    Rounds end when the edges no longer change; there are as many as the logarithm of the longest path needs. Each round is
    written to the checkpoint folder, so that a lost executor costs one round at most. Hubs are joined on their own key, where
    adaptive execution splits skewed partitions; their least neighbour comes from a combined aggregate.
    """
    now = stored(edges.filter("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while True:
        now = stored(_star(_star(now.coalesce(1 + state[0] // TASK_EDGES), True), False))
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
