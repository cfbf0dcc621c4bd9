"""Indexing rows of a table instead of files: probes and a loader for ``update_source``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.config import Source
from gleanery.functions import text as tx
from gleanery.operators import chunking
from gleanery.session import spread
from gleanery.sources.loading import META


def table_probes(documents: DataFrame, source: Source) -> DataFrame:
    """``documents`` has ``path`` and ``text``; the text's hash is the change signature."""
    return documents.select(
        F.lit(source.name).alias("source"), "path", F.lit(None).cast("string").alias("stat_sig"),
        F.sha2("text", 256).alias("git_sha"),
    )


def table_loader(documents: DataFrame):
    """Loads probed rows by joining them back to ``documents`` (``path, doc_date, text``)."""
    def load(probes: DataFrame, source: Source, tasks: int) -> DataFrame:
        path, text = F.col("path"), F.col("text")
        return probes.join(spread(documents.select("path", "doc_date", "text")), "path").select(
            F.lit(source.name).alias("source"), "path", "stat_sig", F.col("git_sha").alias("content_hash"),
            F.octet_length(text).cast("long").alias("bytes"), "doc_date", tx.basename(path).alias("title"), "text",
            F.lit("file").alias("doc_kind"), chunking.layout_for(F.lit(source.type), path).alias("layout"),
            F.lit(None).cast(META).alias("meta"), F.lit("{}").alias("meta_json"),
        )

    return load
