"""Comparing what a source holds now with what was stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


KINDS = ("added", "changed", "deleted", "unchanged")


def diff(probes: DataFrame, stored: DataFrame, *, force: bool = False) -> DataFrame:
    """One row per path with ``change``: added, changed, unchanged or deleted.

    ``probes``: ``source, path, stat_sig, git_sha``; ``stored``: ``source, path,
    stat_sig, content_hash`` plus anything to carry along. A file is unchanged
    when its stat signature is the stored one; a git object when its id is the
    stored hash. ``force`` reloads everything still present.
    """
    here = probes.select(
        "source", "path", "stat_sig", "git_sha", F.lit(True).alias("_here")
    )
    there = stored.withColumnRenamed("stat_sig", "_stat_sig").withColumn("_there", F.lit(True))
    same = (
        F.when(F.col("stat_sig").isNotNull(), F.col("stat_sig").eqNullSafe(F.col("_stat_sig")))
        .when(F.col("git_sha").isNotNull(), F.col("git_sha").eqNullSafe(F.col("content_hash")))
        .otherwise(F.lit(False))
    )
    change = (
        F.when(F.col("_there").isNull(), "added")
        .when(F.col("_here").isNull(), "deleted")
        .when(F.lit(not force) & same, "unchanged")
        .otherwise("changed")
    )
    joined = here.join(there, ["source", "path"], "full_outer")
    return joined.withColumn("change", change).drop("_here", "_there", "_stat_sig")


def counts(changes: DataFrame) -> DataFrame:
    """Rows per source and kind of change."""
    return changes.groupBy("source").agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in KINDS]
    )
