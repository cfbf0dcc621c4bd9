"""Connected components of a graph given as edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.shared import compact, saved, with_groups

#: Edges that one task of a round reads.
TASK_ROWS = 20_000
#: A number that depends on the node alone, for with_groups.
_SECOND = "pmod(xxhash64({0}), 1021)"


def _to_minimum(edges: DataFrame) -> DataFrame:
    """(x, y) edges with m, the least neighbour of x."""
    edges = edges.withColumn("s", F.expr(_SECOND.format("x")))
    least = edges.groupBy("x").agg(F.max("s").alias("s"), F.min("y").alias("m"))
    return with_groups(edges, "x", "s", least)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of the ``edges`` (a, b) but the least ones.

    Each round is written to the shared checkpoint folder. The number of rounds is logarithmic in practice.
    """
    now = edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x != y").distinct()
    now, before = saved(now), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("x").alias("node"), F.col("y").alias("component"))
        before = mark
        now = compact(now, mark[0], TASK_ROWS)
        both = now.union(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        large = _to_minimum(both).where("y > x").select(F.col("y").alias("x"), F.least("x", "m").alias("y")).distinct()
        small = _to_minimum(large)
        again = small.select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e"))
        now = saved(again.select("e.x", "e.y").where("x != y").distinct())
