"""Bringing the index up to date with one source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gleanery.config import Source
from gleanery.functions import analysis, headers
from gleanery.operators import changes, chunking, entities, lexical
from gleanery.operators.sizing import bounded
from gleanery.plans.index import LAYOUT_VERSION, SPAN_BITS, Index, newest_first
from gleanery.plans.snapshots import Part
from gleanery.sources.discovery import probes as discover
from gleanery.sources.loading import load

DOCUMENTS_PER_TASK = 2000


@dataclass(frozen=True)
class Outcome:
    added: int = 0
    changed: int = 0
    deleted: int = 0
    unchanged: int = 0
    chunks: int = 0


def chunked(docs: DataFrame) -> DataFrame:
    """Chunks of loaded documents, with their header lines."""
    source, path, date, title = (F.col(c) for c in ("source", "path", "doc_date", "title"))
    kind = F.col("doc_kind")
    header = (
        F.when(kind == "mail", headers.mail_header(title, F.col("meta")["from"], date))
        .when(kind == "commit", headers.commit_header(source, F.col("content_hash"), F.lit(None), date))
        .otherwise(headers.file_header(source, path))
    )
    block = F.when(kind == "mail", headers.mail_block(F.col("meta"), title, date))
    rows = docs.select(
        "batch", "doc_id", "source", "path", "doc_date", "layout", "text", header.alias("header"), block.alias("block")
    )
    chunks = chunking.chunk_by_layout(rows, F.col("header"), F.col("block"))
    return chunks.withColumn("words", analysis.word_count(F.col("text")))


def compare(index: Index, source: Source, probes: DataFrame, part: int, force: bool) -> tuple[DataFrame, dict[str, int]]:
    """The differences, written down once so that every later step sees the same ones, and how many rows of each kind there are."""
    stored = index.of_source("documents", source.name).select(
        "source", "path", "stat_sig", "content_hash", F.col("batch").alias("gone_batch"), "doc_id"
    )
    seen = Observation()
    every = changes.diff(probes, stored, force=force).observe(
        seen, *[F.count_if(F.col("change") == c).alias(c) for c in changes.KINDS])
    differences = index.append("changes", every.where("change <> 'unchanged'"), part)
    return differences, seen.get


def update_source(index: Index, source: Source, seeds: entities.Seeds, aliases: entities.Aliases, *,
                  probes: DataFrame | None = None, loader=load) -> Outcome:
    """Load what was added or changed, drop what vanished, leave the rest alone.

    ``probes`` and ``loader`` replace the source's own discovery and loading.
    A source last written with another chunk layout is reloaded in full. Raises ConflictError,
    and changes nothing, if another run updated the same source meanwhile.
    """
    base = index.refresh()
    part = index.begin()
    layout = base.layout_of(source.name)
    force = layout is not None and layout != LAYOUT_VERSION
    found = probes if probes is not None else discover(index.spark, source)
    delta, tally = compare(index, source, found, part, force)
    added, changed, deleted, unchanged = (tally[c] for c in changes.KINDS)
    mine = {source.name: [part, LAYOUT_VERSION]}
    if not added + changed + deleted:
        if layout != LAYOUT_VERSION:
            index.publish(Part(part, layouts=mine, unchanged=unchanged), base)
        else:
            index.abandon(part)
        return Outcome(unchanged=unchanged)

    new_chunks = new_words = old_chunks = old_words = 0
    if added + changed:
        fresh = delta.where(F.col("change").isin("added", "changed")).select("path", "stat_sig", "git_sha")
        tasks = max(index.spark.sparkContext.defaultParallelism, (added + changed) // DOCUMENTS_PER_TASK)
        loaded = loader(fresh, source, tasks).withColumns({
            "batch": F.lit(part), "doc_id": F.monotonically_increasing_id(), "content_indexed": F.col("text").isNotNull()})
        docs = index.append("documents", loaded, part)
        chunks = index.append("chunks", chunked(docs), part)
        words = lexical.build_postings(chunks.select("batch", "doc_id", "seq", "source", "doc_date", "text"))
        # Shares are whole spans of documents: what a share leaves out is not taken apart for it.
        index.append_postings(words, part, index.shares("chunks", [part]), F.shiftright("doc_id", SPAN_BITS))
        write_entities(index, docs, part, seeds, aliases)
        new_chunks, new_words = _size(chunks)
    if changed + deleted:
        gone = delta.where(F.col("change").isin("changed", "deleted")).select("gone_batch", "doc_id")
        gone = index.append("retired", gone, part).withColumnRenamed("gone_batch", "batch")
        # Only the source's own parts are opened, and of its chunks no text.
        old = index.read("chunks", F.col("source") == source.name, base.of_source(source.name))
        old_chunks, old_words = _size(old.join(bounded(gone, changed + deleted), ["batch", "doc_id"], "left_semi"))
    index.publish(Part(
        part, layouts=mine, added=added, changed=changed, deleted=deleted, unchanged=unchanged, chunks=new_chunks, words=new_words,
        gone_chunks=old_chunks, gone_words=old_words, retired=changed + deleted), base)
    return Outcome(added, changed, deleted, unchanged, new_chunks)


def merge_parts(index: Index, aliases: entities.Aliases, full: bool = False) -> list[Part]:
    """Merge parts of like sizes until none are left to merge, or all into one. Readers of the old snapshot are not disturbed."""
    done = []
    index.refresh()
    while chosen := index.mergeable(full):
        done.append(index.merge(chosen, lambda rows, part: write_names(index, rows, part, aliases)))
        full = False
    return done


def by_key(rows: DataFrame, *key: str) -> DataFrame:
    """Rows of a key together and sorted, so that lookups by key skip row groups.

    Rebalancing lets Spark split a key too large for one task over several
    files, in one pass (a range partitioning would compute its input twice).
    """
    return rows.hint("rebalance", *map(F.col, key)).sortWithinPartitions(*key)


def _size(chunks: DataFrame) -> tuple[int, int]:
    row = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0))).first()
    return row[0], row[1]


def write_entities(index: Index, docs: DataFrame, part: int, seeds: entities.Seeds,
                   aliases: entities.Aliases) -> None:
    stamped = F.struct(F.lit(part).alias("batch"), "at.source", "at.path", "at.n")
    found = entities.occurrences(docs, seeds).withColumns({"batch": F.lit(part), "at": stamped})
    write_names(index, index.append("occurrences", newest_first(found), part), part, aliases)


def write_names(index: Index, occurrences: DataFrame, part: int, aliases: entities.Aliases) -> None:
    """Spellings of the entities of ``occurrences``, and their links, each listed at both of its ends."""
    votes = entities.name_votes(occurrences)
    links, extra = entities.linked(votes, aliases)
    index.append("names", by_key(votes.unionByName(extra), "key", "kind"), part)
    index.append("links", by_key(entities.both_ends(links), "key", "kind"), part)
