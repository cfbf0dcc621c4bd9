"""Hybrid search over an index."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import analysis
from gleanery.functions import text as tx
from gleanery.functions.snippet import snippet
from gleanery.operators import fusion, lexical, vectors
from gleanery.plans import pruning
from gleanery.plans.index import CHUNK, Index

MODES = ("lexical", "semantic", "hybrid")
HIT = """source string, path string, title string, date string, score double, excerpt string,
    chunk_seq int, content_indexed boolean"""


def scope(sources: list[str] | None, since: str | None, until: str | None) -> Column | None:
    """Filter on ``source`` and the text of ``doc_date``; empty bounds filter nothing."""
    parts = []
    if sources:
        parts.append(F.col("source").isin(*sources))
    if since:
        parts.append(F.col("doc_date") >= since)
    if until:
        parts.append(F.col("doc_date") <= until)
    return reduce(and_, parts) if parts else None


def lexical_scores(index: Index, phrases: list[list[str]], keep: Column | None, limit: int | None = lexical.CANDIDATES) -> DataFrame:
    """Chunks by BM25. Only postings of the query's terms are read; collection
    size comes from the snapshot and is not narrowed by ``keep``."""
    terms = sorted({t for p in phrases for t in p})
    if limit is not None and len(terms) == len(phrases):  # single words, each once
        pruned = pruning.pruned_scores(index, [p[0] for p in phrases], keep, limit)
        if pruned is not None:
            return pruned
    rows = index.live("postings", F.col("term").isin(terms))
    matches = lexical.index_matches(rows, phrases, [*CHUNK, "source", "doc_date"])
    totals = index.totals()
    stats = lexical.index_frequencies(rows, phrases, CHUNK).withColumns(
        {"n": F.lit(totals.chunks), "avgdl": F.lit(totals.words / max(totals.chunks, 1))}
    )
    return lexical.rank_bm25(matches, stats, len(phrases), ["source", *CHUNK], keep, limit)


def lexical_list(index: Index, phrases: list[list[str]], keep: Column | None) -> DataFrame:
    """The top chunks' ranks."""
    order = [F.round("score", lexical.ORDER_DIGITS).desc(), F.col("source"), *map(F.col, CHUNK)]
    return fusion.ranked(lexical_scores(index, phrases, keep), CHUNK, order)


def semantic_list(index: Index, kind: str, query: list[float], keep: Column | None, prefilter: bool) -> DataFrame:
    """Nearest chunks of one vector space; ``keep`` applies after the limit unless ``prefilter``."""
    rows = index.live("vectors", F.col("kind") == kind)
    near = vectors.knn(rows, query, [*CHUNK, "source", "doc_date"], prefilter=keep if prefilter else None)
    kept = near if keep is None else near.where(keep)
    return fusion.ranked(kept, CHUNK, [F.round("distance", vectors.ORDER_DIGITS), *map(F.col, CHUNK)])


def search(index: Index, query: str, *, query_vectors: dict[str, list[float]] | None = None, mode: str = "hybrid",
           sources: list[str] | None = None, since: str | None = None, until: str | None = None,
           limit: int = 10, prefilter: bool = False) -> DataFrame:
    """Documents ranked by reciprocal rank fusion, one row per document, best first."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    keep = scope(sources, since, until)
    phrases = analysis.query_phrases(query) if mode != "semantic" else []
    lists = []
    if phrases:
        lists.append(lexical_list(index, phrases, keep))
    if mode != "lexical":
        lists += [
            semantic_list(index, kind, query_vectors[kind], keep, prefilter)
            for kind in ("prose", "code") if (query_vectors or {}).get(kind)
        ]
    if not lists:
        return index.spark.createDataFrame([], HIT)
    scored = fusion.rrf(lists, CHUNK)
    if phrases:
        scored = scored.join(lists[0].select(*CHUNK, F.lit(True).alias("worded")), CHUNK, "left")
    else:
        scored = scored.withColumn("worded", F.lit(False))
    best = fusion.best_per_document(scored, ["batch", "doc_id"]).collect()  # at most 3 x 50 rows
    return hits(index, best, phrases, limit)


def hits(index: Index, best: list, phrases: list[list[str]], limit: int) -> DataFrame:
    """Texts and records of the winners, found by their ids through row-group pruning."""
    spark = index.spark
    if not best:
        return spark.createDataFrame([], HIT)
    winners = spark.createDataFrame(
        [(r.batch, r.doc_id, r.seq, r.score, bool(r.worded)) for r in best],
        "batch int, doc_id long, seq int, score double, worded boolean",
    )
    mine = F.col("batch").isin(sorted({r.batch for r in best})) & F.col("doc_id").isin(sorted({r.doc_id for r in best}))
    chunks = index.read("chunks", mine).select(*CHUNK, "text")
    records = index.read("documents", mine).select(
        "batch", "doc_id", "source", "path", "title", F.col("doc_date").alias("date"),
        "content_indexed",
    )
    winners = F.broadcast(winners)  # at most 150 rows
    found = chunks.join(winners, CHUNK).join(records, ["batch", "doc_id"])
    top = fusion.top_hits(found, limit)
    worded = F.when(F.col("worded"), F.col("text"))
    shown = F.coalesce(snippet(worded, phrases), tx.excerpt(F.col("text")))
    rows = top.withColumn("excerpt", F.when(shown != "", shown).otherwise(tx.excerpt(F.col("text"))))
    return rows.select(
        "source", "path", "title", "date", "score", "excerpt", F.col("seq").alias("chunk_seq"), "content_indexed"
    ).orderBy(F.col("score").desc(), "source", "path")
