"""Which chunks go to the embedding model, what that costs, and sending them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import text as tx
from gleanery.sources.globs import any_glob

# Estimated USD per million tokens, and the limits of one call.
PRICE_PER_MILLION = {"voyage-3.5": 0.06, "voyage-code-3": 0.18}
CALL_CHUNKS, CALL_TOKENS = 128, 100_000
MAX_RETRIES = 5
TOO_LARGE = "max allowed tokens"

KINDS = ("prose", "code")
CHUNK_FIELDS = (
    ("batch", T.IntegerType(), pa.int32()),
    ("doc_id", T.LongType(), pa.int64()),
    ("seq", T.IntegerType(), pa.int32()),
    ("source", T.StringType(), pa.string()),
    ("doc_date", T.StringType(), pa.string()),
)
_VECTOR_FIELDS = CHUNK_FIELDS + (
    ("kind", T.StringType(), pa.string()),
    ("embedding", T.ArrayType(T.FloatType()), pa.list_(pa.float32())),
    ("tokens", T.LongType(), pa.int64()),
    ("call", T.StringType(), pa.string()),
    ("retries", T.IntegerType(), pa.int32()),
    ("error", T.StringType(), pa.string()),
)
VECTOR = T.StructType([T.StructField(name, kind) for name, kind, _ in _VECTOR_FIELDS])
_VECTOR_ARROW = pa.schema([(name, kind) for name, _, kind in _VECTOR_FIELDS])


def allowed(source: Column, path: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """``rules``: embeddable source -> path globs that stay out."""
    parts = [(source == name) & ~any_glob(path, globs) for name, globs in rules.items()]
    return reduce(or_, parts, F.lit(False))


def eligible(chunks: DataFrame, vectors: DataFrame | None, rules: dict[str, tuple[str, ...]],
             keys: list[str] | None = None) -> DataFrame:
    """Chunks that may be embedded and have no vector yet, with ``kind`` and ``tokens``.

    Both are computed below the join, so that a plan which only counts does not
    move the texts. Without ``vectors`` (none stored yet) nothing is joined.
    """
    queue = chunks.where(allowed(F.col("source"), F.col("path"), rules)).withColumns(
        {"kind": tx.model_kind(F.col("path")), "tokens": tx.estimated_tokens(F.col("text"))}
    )
    keys = keys or ["chunk_id"]
    return queue if vectors is None else queue.join(vectors.select(*keys), keys, "left_anti")


def plan(queue: DataFrame, models: dict[str, str]) -> DataFrame:
    """Chunks, tokens and cost per (source, kind), per kind and in total.

    One pass with grouping sets; ``source``/``kind`` are NULL in the totals.
    """
    price = F.coalesce(
        *[F.when(F.col("kind") == k, F.lit(PRICE_PER_MILLION.get(m, 0.0))) for k, m in models.items()]
    )
    # Summed per kind first: the price is constant within one.
    per_kind = queue.groupBy("source", "kind").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("tokens").alias("tokens")
    ).withColumn("cost_usd", F.col("tokens") * price / F.lit(1_000_000))
    return per_kind.groupingSets(
        [[F.col("source"), F.col("kind")], [F.col("kind")], []], "source", "kind"
    ).agg(
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
    )


def calls(rows: Iterator[dict], kind: str, max_chunks: int, max_tokens: int) -> Iterator[list[dict]]:
    """Group an ordered stream of chunks (with ``text``) into calls within both limits.

    A text larger than the token limit goes alone. Code is budgeted at twice
    its character estimate, because it tokenises more densely.
    """
    weight = 2 if kind == "code" else 1
    call: list[dict] = []
    spent = 0
    for row in rows:
        cost = weight * (len(row["text"]) // tx.CHARS_PER_TOKEN)
        if call and (len(call) == max_chunks or spent + cost > max_tokens):
            yield call
            call, spent = [], 0
        call.append(row)
        spent += cost
    if call:
        yield call


def retryable() -> tuple[type[Exception], ...]:
    """The client library's transient errors; none when it is not installed."""
    try:
        from voyageai import error
    except ImportError:
        return ()
    # Error names of the public client.
    names = ("RateLimitError", "ServiceUnavailableError", "Timeout", "TryAgain", "APIConnectionError", "ServerError")
    return tuple(getattr(error, n) for n in names)


def send(client: Any, texts: list[str], model: str, *, max_retries: int = MAX_RETRIES,
         transient: tuple[type[Exception], ...] | None = None,
         sleep: Callable[[float], None] = time.sleep) -> tuple[list[list[float]], int]:
    """(vectors, retries). Waits 1, 2, 4, ... s after transient errors; a call
    refused for its size is halved until it passes."""
    transient = retryable() if transient is None else transient
    retries = 0
    pending, done = [texts], []
    while pending:
        part = pending.pop()
        for attempt in range(max_retries + 1):
            try:
                done += client.embed(part, model=model, input_type="document").embeddings
                break
            except transient:
                if attempt == max_retries:
                    raise
                retries += 1
                sleep(2 ** attempt)
            except Exception as refusal:
                if len(part) < 2 or TOO_LARGE not in str(refusal).lower():
                    raise
                half = len(part) // 2
                pending += [part[half:], part[:half]]
                break
    return [list(v) for v in done], retries


def embed_chunks(queue: DataFrame, kind: str, model: str, client_factory: Callable[[], Any], *,
                 max_chunks: int = CALL_CHUNKS, max_tokens: int = CALL_TOKENS, max_retries: int = MAX_RETRIES,
                 transient: tuple[type[Exception], ...] | None = None) -> DataFrame:
    """Vectors of the queue's ``kind`` chunks, one client per task, streaming through it.

    Calls are formed within a task in document order; each row says which
    call it came from, and the first row of a call how many retries it took. A call
    that fails for good ends its task with a row that has ``error`` and no vector.
    """
    names = [name for name, _, _ in CHUNK_FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = None
        rows = (row for b in batches for row in b.to_pylist())
        for call in calls(rows, kind, max_chunks, max_tokens):
            label = f"{call[0]['batch']}/{call[0]['doc_id']}/{call[0]['seq']}"
            try:
                client = client or client_factory()
                vectors, retries = send(
                    client, [r["text"] for r in call], model, max_retries=max_retries, transient=transient
                )
            except Exception as refusal:
                yield pa.RecordBatch.from_pylist([{"kind": kind, "call": label, "error": str(refusal) or repr(refusal)}], _VECTOR_ARROW)
                return
            yield pa.RecordBatch.from_pylist([
                {
                    **{n: row[n] for n in names}, "kind": kind, "embedding": vector,
                    "tokens": len(row["text"]) // tx.CHARS_PER_TOKEN, "call": label,
                    "retries": 0 if i else retries,
                }
                for i, (row, vector) in enumerate(zip(call, vectors, strict=True))
            ], _VECTOR_ARROW)

    ordered = queue.where(F.col("kind") == kind).select(*names, "text").sortWithinPartitions("batch", "doc_id", "seq")
    return ordered.mapInArrow(run, VECTOR)
