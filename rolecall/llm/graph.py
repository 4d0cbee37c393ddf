"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import BROADCAST_ROWS, checkpointed, written


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component) for every node of an edge; component is the least id reachable.

    Each round is joins and partial minima only, and ends in the shared
    checkpoint folder; the driver reads three numbers a round.  The least
    neighbours, one row for each node, are broadcast while the count of edges
    bounds them; beyond that they are a table of their own, so that the join meets
    plain shuffles on both sides and Spark splits the edges of a hub over tasks.
    """
    now = checkpointed(_down(edges.select(F.col(a).alias("x"), F.col(b).alias("y"))))
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")), F.sum(F.col("y").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = now.union(now.select("y", "x"))
        nodes = F.broadcast if 2 * state[0] <= BROADCAST_ROWS else written
        least = nodes(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = _down(large)
        low = nodes(large.groupBy("x").agg(F.min("y").alias("m")))
        small = large.join(low, "x").select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("m").alias("y"))
        now = checkpointed(_down(small))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ids = now.select(F.col("x").alias("id"), F.col("y").alias("component"))
    return ids.union(now.select("y", "y")).distinct()


def _down(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller id, each once, without loops."""
    return edges.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
