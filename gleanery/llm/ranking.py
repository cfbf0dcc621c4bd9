"""Positions of rows in a seeded shuffle, without putting a group into one task.

A row's place in the shuffle is a uniform hash, so equal ranges of the hash hold about equally many rows
of every group, however large it is. Rows are ranked inside (group, range); the ranges before it add the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one range holds on average: what one sort has to hold.
ROWS_PER_RANGE = 2048


def group_key(col: Column) -> Column:
    """A group's name that tells null from any string."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def shuffle_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def hash_range(key: Column, ranges: int) -> Column:
    """Which of ``ranges`` equal ranges a hexadecimal key falls into."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(1 << 32) * ranges).cast("long")


def ranges_for(rows: int) -> int:
    return rows // ROWS_PER_RANGE + 1


def ranked(df: DataFrame, group: list[str], cell: str, order: list[str], rank: str, total: str) -> DataFrame:
    """``df`` with its 0-based ``rank`` within ``group`` by (``cell``, ``order``), and the ``total`` of the group.

    ``cell`` orders ranges of rows as ``order`` does and bounds what is sorted at once.
    """
    keys = [*group, cell]
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(*keys).agg(F.count("*").alias("_in_cell"))
    cells = cells.select(
        *keys,
        F.coalesce(F.sum("_in_cell").over(before), F.lit(0)).alias("_before"),
        F.sum("_in_cell").over(Window.partitionBy(*group)).alias(total),
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    placed = df.withColumn("_inside", inside).join(cells, keys)
    return placed.withColumn(rank, F.col("_before") + F.col("_inside") - 1).drop("_inside", "_before")
