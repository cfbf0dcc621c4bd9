"""Exact nearest neighbours by Euclidean distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.operators.lexical import CANDIDATES, ORDER_DIGITS


def l2_distance(vector: Column | str, query: list[float]) -> Column:
    """Distance of each vector to ``query``; one numpy pass per Arrow batch."""
    target = np.asarray(query, dtype=np.float64)

    @F.arrow_udf(T.DoubleType())
    def distance(column: pa.Array) -> pa.Array:
        if column.null_count:
            raise ValueError("vector column holds NULLs")
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(values) != len(column) * len(target):
            raise ValueError(f"every vector must have {len(target)} dimensions")
        gaps = values.reshape(len(column), len(target)) - target
        return pa.array(np.sqrt((gaps * gaps).sum(axis=1)))

    return distance(vector)


def knn(vectors: DataFrame, query: list[float], keys: list[str], *, vector: str = "embedding",
        k: int = CANDIDATES, prefilter: Column | None = None) -> DataFrame:
    """The ``k`` nearest rows: ``keys`` and ``distance``.

    Each task keeps its own best ``k``; only those meet in the final merge.
    Filters on the result come after the limit, as an exact-k index behaves;
    ``prefilter`` narrows the candidates first instead.
    """
    rows = vectors if prefilter is None else vectors.where(prefilter)
    measured = rows.select(*keys, l2_distance(F.col(vector), query).alias("distance"))
    return measured.orderBy(F.round("distance", ORDER_DIGITS), *keys).limit(k)
