"""Exact deduplication by progressive refinement.

Documents are grouped by length, then by a hash of their prefix, then by a hash of the whole text. Each
level looks only at what the level above could not tell apart: a sieve of fixed size carries the groups
that still hold two documents back to the scan, so texts never move. Only a text whose length and prefix
both occur twice is hashed in full.

Defined results: null texts count as empty. Texts are equal when identical after lower-casing A-Z. The
largest id of a group stays (nulls are smaller than any id); rows that repeat an id with an equal text
are one document and share its verdict. An empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.shared import fresh, marked, quoted, sieve, with_groups

PREFIX_CHARS = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def full_hash(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def repeated(keys: DataFrame) -> DataFrame:
    return keys.groupBy(*keys.columns).count().where("count > 1").drop("count")


def refine(docs: DataFrame, text: str, length: str, digest: str) -> DataFrame:
    """``docs`` with the byte ``length`` of the text and ``digest``, its full hash if another text may equal it."""
    body = F.coalesce(quoted(text), F.lit(""))
    prefix_hash = F.xxhash64(normalised(F.substring(body, 1, PREFIX_CHARS)))
    flag, prefix = fresh(docs, "_twin", "_prefix")
    by_length = sieve(repeated(docs.select(F.octet_length(body).alias(length))))
    sized = marked(docs.withColumn(length, F.octet_length(body)), by_length, [F.col(length)], flag)
    sized = sized.withColumn(prefix, F.when(F.col(flag), prefix_hash)).drop(flag)
    pairs = repeated(sized.where(F.col(prefix).isNotNull()).select(length, prefix))
    narrowed = marked(sized, sieve(pairs), [F.col(length), F.col(prefix)], flag)
    survives = F.col(flag) & F.col(prefix).isNotNull()
    return narrowed.withColumn(digest, F.when(survives, full_hash(quoted(text)))).drop(flag, prefix)


def groups(refined: DataFrame, doc_id: str, length: str, digest: str) -> DataFrame:
    """One row per group of two or more equal texts: digest, length, keep_id, group_size."""
    return (
        refined.where(F.col(digest).isNotNull())
        .groupBy(digest)
        .agg(F.max(length).alias(length), F.max(quoted(doc_id)).alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept (and every text's hash with ``digests``)."""
    docs = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    refined = refine(docs, "text", "_length", "_digest")
    if digests:
        refined = refined.withColumn("text_sha256", F.coalesce("_digest", full_hash(F.col("text"))))
    lone = F.hex(F.xxhash64("doc_id", "_length"))  # spreads texts that are alone; shorter than any digest
    members = refined.drop("text").withColumn("_key", F.coalesce("_digest", lone))
    shared = groups(refined.drop("text"), "doc_id", "_length", "_digest").withColumnRenamed("_digest", "_key")
    out = with_groups(members, "_key", "_length", shared, "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), *(["text_sha256"] if digests else []),
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that :func:`exact_duplicates` drops. Only texts that may have a twin move."""
    length, digest = fresh(docs, "_length", "_digest")
    refined = refine(docs, text, length, digest)
    alone = refined.where(F.col(digest).isNull()).select(*[quoted(c) for c in docs.columns])
    key, second, keep = fresh(refined, "_key", "_second", "_keep")
    shared = groups(refined, doc_id, length, digest).select(
        F.col(digest).alias(key), F.col(length).alias(second), F.col("keep_id").alias(keep)
    )
    twins = refined.where(F.col(digest).isNotNull()).withColumns({key: F.col(digest), second: F.col(length)})
    joined = with_groups(twins, key, second, shared, "left")
    stays = F.col(keep).isNull() | quoted(doc_id).eqNullSafe(F.col(keep))
    return alone.unionByName(joined.where(stays).select(*[quoted(c) for c in docs.columns]))
