"""One object for everything a configured corpus offers."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.config import Config
from gleanery.functions import text as tx
from gleanery.operators import chunking, documents, embedding, entities
from gleanery.plans import embed as embedding_plan
from gleanery.plans import search as searching
from gleanery.plans.index import Index
from gleanery.plans.snapshots import Part
from gleanery.plans.update import Outcome, merge_parts, update_source
from gleanery.sources.names import load_aliases, load_seeds, write_alias_review

DOC = ("batch", "doc_id")

class NotFound(LookupError):
    """No such document or entity."""


class Engine:
    """``client_factory`` builds the embedding client inside tasks; the default is the public one."""

    def __init__(self, spark: SparkSession, config: Config, client_factory: Callable[[], Any] | None = None):
        self.config, self.client_factory = config, client_factory
        self.index = Index(spark, config.db)

    # --- indexing ---------------------------------------------------------------

    def update(self, sources: Iterable[str] | None = None) -> dict[str, Outcome]:
        """Converge the named sources (all by default), each as its own commit."""
        known = [s.name for s in self.config.sources]
        names = list(sources) if sources is not None else known
        if unknown := [n for n in names if n not in known]:
            raise ValueError(f"unknown source(s): {', '.join(unknown)}")
        seeds, aliases = load_seeds(self.config.seeds), load_aliases(self.config.aliases)
        return {n: update_source(self.index, self.config.source(n), seeds, aliases) for n in names}

    def compact(self, full: bool = False) -> list[Part]:
        """Merge the index's parts; see ``gleanery.plans.update.merge_parts``."""
        return merge_parts(self.index, load_aliases(self.config.aliases), full)

    def clean(self, keep: int = 1) -> list[int]:
        """Delete what only older snapshots than the newest ``keep`` refer to."""
        return self.index.clean(keep)

    def embed_plan(self) -> DataFrame:
        return embedding_plan.plan(self.index, self.config)

    def embed(self, **limits) -> embedding_plan.EmbedOutcome:
        return embedding_plan.drain(self.index, self.config, self.client_factory, **limits)

    # --- searching --------------------------------------------------------------

    def has_vectors(self) -> bool:
        return not self.index.live("vectors").isEmpty()

    def query_vectors(self, query: str) -> dict[str, list[float]]:
        return embedding_plan.query_vectors(query, self.config, self.client_factory)

    def search(self, query: str, **options) -> DataFrame:
        """See ``gleanery.plans.search.search``; vectors are the caller's."""
        return searching.search(self.index, query, **options)

    # --- lookups ------------------------------------------------------------------

    def document(self, source: str, path: str) -> DataFrame:
        """One row; ``content`` is NULL when the document is not content-indexed."""
        record = self.index.of_source("documents", source, F.col("path") == path).select(*DOC).first()
        if record is None:
            raise NotFound(f"document {path!r} of {source!r}: not found")
        mine = (F.col("batch") == record.batch) & (F.col("doc_id") == record.doc_id)
        content = chunking.reconstruct(self.index.read("chunks", mine).select("doc_id", "seq", "text"))
        found = self.index.read("documents", mine)
        return found.join(content, "doc_id", "left").select(
            "source", "path", "title", "doc_date", "bytes", "content_hash", "content_indexed",
            F.col("meta_json").alias("meta"),
            # An indexed document without any chunk has empty content, not none.
            F.when(F.col("content_indexed"), F.coalesce("content", F.lit(""))).alias("content"),
        )

    def clipped_document(self, source: str, path: str, max_chars: int) -> DataFrame:
        text, cut = tx.clip(F.col("content"), max_chars)
        return self.document(source, path).select(
            "source", "path", "title", F.col("doc_date").alias("date"), "meta", "content_indexed",
            text.alias("content"), F.coalesce(cut, F.lit(False)).alias("truncated"),
        )

    def entity(self, key: str, kind: str | None = None) -> DataFrame:
        """Entities answering to ``key``, best kind first."""
        names = self.index.read("names", F.col("key") == key)
        return entities.find(entities.entities(names), key, kind)

    def _known(self, ends: DataFrame) -> DataFrame:
        """Display names of just the entities in ``ends``."""
        return entities.entities(self.index.read("names").join(ends.distinct(), ["kind", "key"], "left_semi"))

    def _links(self, kind: str, key: str) -> tuple[DataFrame, DataFrame]:
        """Links of one entity, found at its own end, and the names at both ends."""
        mine = (F.col("kind") == kind) & (F.col("key") == key)
        links = entities.from_ends(self.index.read("links", mine))
        ends = links.select(F.inline(F.array(*[
            F.struct(F.col(f"{end}_kind").alias("kind"), F.col(f"{end}_key").alias("key")) for end in "ab"])))
        return links, self._known(ends)

    def entity_links(self, kind: str, key: str) -> DataFrame:
        return entities.directed_links(*self._links(kind, key), kind, key)

    def entity_neighbours(self, kind: str, key: str) -> DataFrame:
        return entities.neighbours(*self._links(kind, key), kind, key)

    def entity_documents(self, kind: str, key: str, limit: int = 20) -> DataFrame:
        """The newest documents of an entity. Its occurrences know their dates, so only the documents shown are looked up.

        A document may be named by several occurrences, which stand side by side in this order; more
        of the first rows are asked for until they hold ``limit`` documents.
        """
        mine = self.index.live("occurrences", (F.col("kind") == kind) & (F.col("key") == key))
        rows = mine.select(*DOC, "doc_date", "at.source", "at.path", "rel").orderBy(
            F.col("doc_date").desc_nulls_last(), "source", "path", "rel")
        asked, newest = 4 * limit, {}
        while limit and len(newest) < limit:
            first = rows.limit(asked).collect()
            newest = dict.fromkeys((r.batch, r.doc_id, r.rel) for r in first)
            if len(first) < asked:
                break
            asked *= 4
        shown = list(newest)[:limit]
        edges = self.index.spark.createDataFrame(
            [(*row, kind, key) for row in shown], "batch int, doc_id long, rel string, kind string, key string")
        ids = F.col("batch").isin(sorted({r[0] for r in shown})) & F.col("doc_id").isin(sorted({r[1] for r in shown}))
        records = self.index.read("documents", ids)
        return entities.newest_documents(F.broadcast(edges), records, kind, key, limit, DOC)  # ``limit`` rows

    # --- reports --------------------------------------------------------------------

    def stats(self) -> DataFrame:
        return documents.source_stats(
            self.index.live("documents"), self.index.live("chunks"), self.index.read("vectors"),
            [s.name for s in self.config.sources], ("batch", "doc_id"), "seq",
        )

    def alias_review(self, top_n: int = 200) -> DataFrame:
        rels = (*entities.CORRESPONDENT_RELS, "author")
        edges = self.index.live("occurrences", F.col("rel").isin(*rels)).select(*DOC, "kind", "key", "rel").distinct()
        known = entities.entities(self.index.read("names", F.col("kind") == "email"))
        return entities.alias_review(edges, known, top_n, DOC)

    def write_alias_review(self, path: str, top_n: int = 200) -> None:
        write_alias_review(self.alias_review(top_n), path, top_n)


def plan_lines(plan: DataFrame) -> list[str]:
    """The embedding plan as text: per source and kind, per kind, total."""
    # The words, their order and the four decimals of this report.
    rows = {(r.source, r.kind): r for r in plan.collect()}  # at most sources x kinds + 3

    def line(label: str, row) -> str:
        chunks, tokens, cost = (row.chunks, row.tokens, row.cost_usd) if row else (0, 0, 0.0)
        return f"{label}: chunks={chunks} tokens={tokens} cost_usd={cost:.4f}"

    detail = [line(f"{s} [{k}]", rows[s, k]) for s, k in sorted(k for k in rows if k[0] is not None)]
    kinds = [line(f"total [{k}]", rows.get((None, k))) for k in embedding.KINDS]
    return [*detail, *kinds, line("total", rows.get((None, None)))]
