"""Which rows a model may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.shared import quoted


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds`` (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def sample(rows: DataFrame, doc_id: str, size: int) -> DataFrame:
    """At most ``size`` rows, the first in the order of a hash of their id and content: the same at every run."""
    order = F.xxhash64(F.lit("sample"), quoted(doc_id))
    return rows.orderBy(order, *[quoted(c) for c in rows.columns]).limit(size)
