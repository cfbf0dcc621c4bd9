"""Reciprocal rank fusion, collapse to documents, final ordering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60  # fixed value


def ranked(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``keys`` and 1-based ``rank`` of an already limited list (one list = one small window)."""
    window = Window.partitionBy("_list").orderBy(*order)
    return rows.withColumn("_list", F.lit(0)).select(*keys, F.row_number().over(window).alias("rank"))


def rrf(lists: list[DataFrame], keys: list[str], k: int = RRF_K) -> DataFrame:
    """``keys`` and ``score`` = sum of 1/(k+rank) over the lists, added in list order."""
    tagged = [
        rows.select(*keys, "rank", F.lit(i).alias("_list")) for i, rows in enumerate(lists)
    ]
    every = reduce(DataFrame.unionByName, tagged)
    shares = [
        F.coalesce(
            F.max(F.when(F.col("_list") == i, F.lit(1.0) / (F.lit(k) + F.col("rank")))), F.lit(0.0)
        )
        for i in range(len(lists))
    ]
    return every.groupBy(*keys).agg(reduce(lambda a, b: a + b, shares).alias("score"))


def best_per_document(scored: DataFrame, doc: list[str], seq: str = "seq") -> DataFrame:
    """The best chunk of each document; equal scores go to the earliest chunk."""
    window = Window.partitionBy(*doc).orderBy(F.col("score").desc(), F.col(seq))
    return scored.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def top_hits(hits: DataFrame, limit: int) -> DataFrame:
    return hits.orderBy(F.col("score").desc(), "source", "path").limit(limit)
