"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seed within their source and ranked; the row of rank r among the n rows of its
source gets the fraction (2r + 1) / 2n. Sorted by fraction, every stretch of the order holds the sources in
proportion, and cutting it into equal counts gives shards that all match the mixture.

Defined results: law ``rows`` (shard sizes differ by one row at most). Null sources form a stratum, null
texts are empty, null ids are shuffled like any other; rows that repeat an id are ordered by size and
checksum and each takes a slot of its own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.ranking import group_key, hash_range, ranges_for, ranked, shuffle_key
from gleanery.llm.shared import quoted

SHARDS, SEED = 40, 20
ROW_BYTES = 16


def shards(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
           source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, source."""
    body = F.coalesce(quoted(text), F.lit(""))
    rows = docs.select(
        quoted(doc_id).alias("doc_id"), quoted(source).alias("source"), group_key(quoted(source)).alias("stratum"),
        (F.octet_length(body).cast("long") + ROW_BYTES).alias("size"), F.crc32(body).alias("text_crc32"),
        shuffle_key(quoted(doc_id), seed).alias("shuffled"),
    )
    n = docs.count()
    ranges = ranges_for(n)
    rows = rows.withColumn("cell", hash_range(F.col("shuffled"), ranges))
    rows = ranked(rows, ["stratum"], "cell", ["shuffled", "doc_id", "size", "text_crc32"], "rank", "in_stratum")
    fraction = (2 * F.col("rank") + 1) / (2 * F.col("in_stratum"))
    rows = rows.withColumn("fraction", fraction).withColumn("cell", F.floor(F.col("fraction") * ranges))
    rows = ranked(rows, [], "cell", ["fraction", "stratum", "rank"], "place", "rows")
    # Shard s takes the places p with floor(p * n_shards / rows) = s.
    rows = rows.withColumn("shard", F.expr(f"place * {n_shards}L div rows"))
    first = F.expr(f"(rows * shard + {n_shards - 1}L) div {n_shards}L")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source",
    )
