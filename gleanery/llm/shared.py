"""Helpers of the training-data operators: fresh names, checkpoints, bounded sieves, skew-safe regrouping."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a sieve. Its broadcast is SIEVE_BITS / 8 bytes (4 MB) whatever the data hold.
SIEVE_BITS = 1 << 25
#: Bits of one bitmap of Spark's bitmap functions.
BITMAP_BITS = 32768


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def scratch(spark: SparkSession) -> None:
    """Make checkpoint() usable: the cluster's folder, or one of our own on a single machine that names none (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors would write where no other one reads")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="run-checkpoints-"))


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; its lineage ends there."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again; its lineage ends there."""
    spark = df.sparkSession
    scratch(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def compact(df: DataFrame, n_rows: int, per_task: int) -> DataFrame:
    """``df``, a saved table of ``n_rows`` rows, in tasks of about ``per_task`` rows instead of one per saved part."""
    return df.coalesce(n_rows // per_task + 1)


def sieve(keys: DataFrame, bits: int = SIEVE_BITS) -> DataFrame:
    """A bitmap of the rows of ``keys``: never misses a key, may let others pass.

    One row per bitmap of 4 KB, ``bits / 32768`` rows at most, so that its broadcast has a fixed bound.
    """
    spot = F.pmod(F.xxhash64(*[quoted(c) for c in keys.columns]), F.lit(bits))
    return (
        keys.select(spot.alias("spot"))
        .groupBy(F.bitmap_bucket_number("spot").alias("cell"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    )


def marked(df: DataFrame, by: DataFrame, key: list[Column], name: str, bits: int = SIEVE_BITS) -> DataFrame:
    """``df`` with the boolean ``name``: whether the sieve ``by`` holds ``key``. No shuffle of ``df``."""
    spot, cell, content, right = fresh(df, "_spot", "_cell", "_bits", "_right")
    cells = by.select(F.col("cell").alias(right), F.col("bits").alias(content))
    df = df.withColumn(spot, F.pmod(F.xxhash64(*key), F.lit(bits)))
    df = df.withColumn(cell, F.bitmap_bucket_number(F.col(spot)))
    place = F.bitmap_bit_position(F.col(spot))
    byte = F.conv(F.hex(F.substring(F.col(content), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.bit_get(byte, (place % 8).cast("int")) == 1
    out = df.join(F.broadcast(cells), F.col(cell) == F.col(right), "left")
    return out.withColumn(name, F.coalesce(bit, F.lit(False))).drop(spot, cell, content, right)


def with_groups(members: DataFrame, key: str, second: str, groups: DataFrame, how: str = "inner") -> DataFrame:
    """Members with the columns of their group.

    ``groups`` has one row per ``key`` and was aggregated by ``key`` alone; ``second`` depends on ``key``.
    Joining on both makes Spark deal out both sides anew for this join, so that adaptive execution may
    split the rows of a hot key over many tasks.
    """
    return members.join(groups, [key, second], how)
