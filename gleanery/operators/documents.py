"""Per-source counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source_stats(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, sources: list[str],
                 doc: tuple[str, ...] = ("doc_id",), seq: str = "seq") -> DataFrame:
    """``source, documents, chunks, embedded`` for every listed source, empty ones included.

    Chunks and vectors are counted per document before they meet, so no join
    carries more than one row per document.
    """
    counted = chunks.groupBy(*doc).agg(F.count(F.lit(1)).alias("_chunks"))
    done = vectors.select(*doc, seq).distinct().groupBy(*doc).agg(F.count(F.lit(1)).alias("_embedded"))
    per_doc = documents.select("source", *doc).join(counted, list(doc), "left").join(done, list(doc), "left")
    per_source = per_doc.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("_chunks"), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum("_embedded"), F.lit(0)).alias("embedded"),
    )
    listed = documents.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    return listed.join(per_source, "source", "left").na.fill(0, ["documents", "chunks", "embedded"])
