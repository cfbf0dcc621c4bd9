"""The index as a folder of Parquet tables.

Every run writes one ``part=N`` folder per table and finishes by publishing a
snapshot that lists the part (``snapshots``). Readers open the parts of one
snapshot, so that a run which failed, or has not finished, is invisible. Nothing is
rewritten in place: a changed or deleted document is listed in ``retired``, and its rows drop
out of reads by an anti join, until ``compaction`` merges parts and leaves them out. A row's
identity is (batch, doc_id[, seq]): the run that loaded the document and its number there. It
stays the same when parts are merged.

Layout within a part serves pruning: postings are grouped and sorted by term
(a very common term is split over several files), occurrences and names by key,
documents by path, chunks in document order, links once by either end.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.operators.sizing import bounded
from gleanery.plans.snapshots import ConflictError, Part, Snapshot, SnapshotLog
from gleanery.session import freed_shuffles, ship_package
from gleanery.sources.loading import META

SCHEMA_VERSION = "2"
LAYOUT_VERSION = "3"  # raise it whenever chunks of unchanged documents would come out differently

AT = "struct<batch:int,source:string,path:string,n:int>"
TABLES = {
    "documents": f"""batch int, doc_id long, source string, path string, stat_sig string, content_hash string, bytes long,
        doc_date string, title string, content_indexed boolean, text string, doc_kind string, layout string,
        meta {META.simpleString()}, meta_json string""",
    "chunks": "batch int, doc_id long, seq int, source string, path string, doc_date string, text string, words int",
    "postings": """term string, batch int, span long, doc_id long, seq int, source string, doc_date string, dl int, tf int,
        positions array<int>""",
    "blocks": "part int, term string, batch int, span long, n long, max_tf int, min_dl int",
    "occurrences": f"""batch int, doc_id long, kind string, key string, rel string, display string, doc_date string,
        at {AT}""",
    "names": f"kind string, key string, display string, votes long, at {AT}",
    "links": "end string, kind string, key string, rel string, other_kind string, other_key string",
    "retired": "gone_batch int, doc_id long",
    "changes": """source string, path string, stat_sig string, git_sha string, gone_batch int, doc_id long,
        change string""",
    "vectors": """batch int, doc_id long, seq int, kind string, source string, doc_date string, embedding array<float>,
        tokens long, call string, retries int, error string""",
}
CHUNK = ["batch", "doc_id", "seq"]
BLOOM = {"documents": ["path"], "postings": ["term"], "occurrences": ["key"], "names": ["key"], "links": ["key"], "blocks": ["term"]}
#: Documents (as a power of two) that share a span, and postings from which a term's list in a part has blocks.
SPAN_BITS, LONG_LIST = 8, 1 << 16
#: Parts of about the same size that are merged together, and the step from one size to the next.
FAN = 4
#: Stored bytes of texts and vectors that one task of a merge reads and sorts into one file.
TASK_BYTES = 20 << 20
#: Stored bytes of chunks or postings whose postings are shuffled at once, and the most shares that they are dealt into.
SHARE_BYTES, MOST_SHARES = 1 << 26, 4


class SchemaVersionError(RuntimeError):
    """The index was written by an incompatible version."""


@dataclass(frozen=True)
class Totals:
    """Live collection totals, added up from the parts."""

    chunks: int
    words: int
    retired: int


def newest_first(found: DataFrame) -> DataFrame:
    """Occurrences laid out so that an entity's newest documents stand together."""
    return found.hint("rebalance", F.col("key"), F.col("kind")).sortWithinPartitions("key", "kind", F.col("doc_date").desc_nulls_last())


def by_span(postings: DataFrame) -> DataFrame:
    """Postings laid out so that a term's rows of neighbouring documents stand together.

    Rebalancing lets Spark split a term too large for one task over several files, in one pass (a range
    partitioning would compute its input twice).
    """
    dealt = postings.drop("span").hint("rebalance", F.col("term"))  # spans follow from the ids, so they need not move
    return dealt.withColumn("span", F.shiftright("doc_id", SPAN_BITS)).sortWithinPartitions("term", "batch", "span")


def blocks_of(postings: DataFrame) -> DataFrame:
    """What is best in each span of a term: the largest count and the shortest text."""
    return postings.groupBy("term", "batch", "span").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))


class Index:
    """``version`` opens an older snapshot, for reading, as long as its parts have not been cleaned away."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root = ship_package(spark), root.rstrip("/")
        self.log = SnapshotLog(spark, self.root)
        self.snapshot = self.log.load(version)
        if self.snapshot is None:
            if self.log.exists() and self.log._files.exists(self.log._path("commits")):
                raise SchemaVersionError(f"{root} was written by an older version of this library; build it anew")
            self.log.publish(Snapshot(0, SCHEMA_VERSION))  # if another writer was first, its snapshot is as good
            self.snapshot = self.log.load()
        if self.snapshot.schema != SCHEMA_VERSION:
            raise SchemaVersionError(f"{root} has schema {self.snapshot.schema}, this library writes {SCHEMA_VERSION}")

    # --- writing --------------------------------------------------------------

    def refresh(self) -> Snapshot:
        """Look at what is published now."""
        self.snapshot = self.log.load()
        return self.snapshot

    def begin(self, kind: str = "update") -> int:
        """A number for a run, which may write parts under it."""
        return self.log.reserve(kind)

    def abandon(self, number: int) -> None:
        """Give back the number of a run that has nothing to publish."""
        self.log.drop_part(list(TABLES), number)
        self.log.drop("runs", number)

    def append(self, name: str, rows: DataFrame, part: int, mode: str = "overwrite", **options: str) -> DataFrame:
        """Write one table's rows of ``part`` and return them as stored. What was shuffled for it is deleted."""
        schema = T.StructType.fromDDL(TABLES[name])
        chosen = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema])
        writer = chosen.write.mode(mode).option("compression", "zstd").option("parquet.bloom.filter.adaptive.enabled", "true").options(**options)
        for column in BLOOM.get(name, []):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        path = f"{self.root}/{name}/part={part}"
        with freed_shuffles(self.spark):
            writer.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def shares(self, name: str, parts: Iterable[int]) -> int:
        """How many shares the postings of these parts of a table are shuffled in."""
        return min(sum(self.log.size(name, n) for n in parts) // SHARE_BYTES + 1, MOST_SHARES)

    def append_postings(self, postings: DataFrame, part: int, shares: int = 1, by: Column | None = None) -> None:
        """Postings of ``part``, and the blocks of its long lists.

        Shares are written one after the other, so that no more than one of them is shuffled, and on disk twice, at a time.
        ``by`` deals them out, by default the term; it should be known before any costly step, as all rows are read for each share.
        """
        place = F.pmod(F.xxhash64(F.col("term") if by is None else by), F.lit(shares))
        for n in range(shares):
            share = postings if shares == 1 else postings.where(place == n)
            stored = self.append("postings", by_span(share), part, "append" if n else "overwrite")
        long = stored.groupBy("term").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= LONG_LIST).select("term")
        # One row per LONG_LIST postings at most; only the postings of long lists are grouped.
        blocks = blocks_of(stored.join(F.broadcast(long), "term", "left_semi"))
        self.append("blocks", blocks.withColumn("part", F.lit(part)).sortWithinPartitions("term"), part)

    def publish(self, part: Part, base: Snapshot, replaces: Iterable[int] = ()) -> None:
        """Add ``part``, made from ``base``, and take out the parts it ``replaces``.

        What others published since ``base`` stays. An update conflicts with another update of its sources, a merge with
        another merge of its parts; an update and a merge do not conflict, as identities of rows outlive merges.
        """
        known, gone = set(base.numbers()), set(replaces)
        while True:
            now = self.log.load()
            if part.part in now.numbers():
                break
            news = [p for p in now.parts if p.part not in known]
            if part.kind == "update" and any(p.kind == "update" and p.layouts.keys() & part.layouts.keys() for p in news):
                raise ConflictError(f"another run updated {', '.join(part.layouts)} meanwhile; run the update again")
            if not gone <= set(now.numbers()):
                raise ConflictError("another run merged some of these parts meanwhile")
            parts = (*[p for p in now.parts if p.part not in gone], part)
            if self.log.publish(Snapshot(now.version + 1, SCHEMA_VERSION, parts)):
                break
        self.refresh()

    def clean(self, keep: int = 1, unpublished_after: float = 7 * 86400) -> list[int]:
        """Delete all but the newest ``keep`` snapshots, parts that no snapshot has any more, and what runs left that
        began more than ``unpublished_after`` seconds ago and never published. Returns the numbers of the parts."""
        versions = self.log.versions()
        kept, old = versions[-max(keep, 1):], versions[:-max(keep, 1)]
        used = {n for v in kept for n in self.log.load(v).numbers()}
        replaced = {n for v in old for n in self.log.load(v).numbers()} - used
        dead = {n for n in self.log.reserved() if n not in used | replaced and time.time() - self.log.began(n) > unpublished_after}
        for version in old:  # first what refers to the parts, then the parts
            self.log.drop("log", version)
        for number in sorted(replaced | dead):
            self.log.drop_part(list(TABLES), number)
            self.log.drop("runs", number)  # rows may bear a replaced part's number: it is smaller than that of the part they are in
        return sorted(replaced | dead)

    # --- reading --------------------------------------------------------------

    def read(self, name: str, where: Column | None = None, parts: Iterable[int] | None = None) -> DataFrame:
        """All rows of the snapshot (or of some of its parts), those of replaced and deleted documents included."""
        schema = T.StructType.fromDDL(TABLES[name])
        numbers = [n for n in (self.snapshot.numbers() if parts is None else parts) if self.log.has_rows(name, n)]
        if not numbers:
            rows = self.spark.createDataFrame([], schema).limit(0)  # known to be empty, so that joins with it shuffle nothing
        else:
            rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/part={n}" for n in numbers])
        if name == "vectors":  # the others say why a run stopped
            rows = rows.where("error IS NULL")
        return rows if where is None else rows.where(where)

    def totals(self) -> Totals:
        parts = self.snapshot.parts
        return Totals(
            sum(p.chunks - p.gone_chunks for p in parts), sum(p.words - p.gone_words for p in parts), sum(p.retired for p in parts))

    def live(self, name: str, where: Column | None = None, parts: Iterable[int] | None = None) -> DataFrame:
        """Rows of current documents; ``where`` applies at the scan."""
        rows = self.read(name, where, parts)
        retired = self.totals().retired
        if not retired:
            return rows
        gone = self.read("retired").select(F.col("gone_batch").alias("batch"), "doc_id")
        return rows.join(bounded(gone, retired), ["batch", "doc_id"], "left_anti")

    def of_source(self, name: str, source: str, where: Column | None = None) -> DataFrame:
        """Live rows of one source: only parts that hold it are opened, its name prunes the rest."""
        mine = F.col("source") == source
        return self.live(name, mine if where is None else mine & where, self.snapshot.of_source(source))

    # --- merging ----------------------------------------------------------------

    def mergeable(self, full: bool = False) -> list[Part]:
        """Parts worth merging: FAN or more of one size (sizes grow FAN-fold), with all smaller ones; or all parts."""
        parts = sorted(self.snapshot.parts, key=lambda p: p.chunks)
        if full:
            return parts if len(parts) > 1 or any(p.retired for p in parts) else []
        size = {p.part: next(i for i in range(64) if p.chunks < FAN ** (i + 1)) for p in parts}
        crowded = [s for s in set(size.values()) if sum(v == s for v in size.values()) >= FAN]
        return [p for p in parts if size[p.part] <= max(crowded)] if crowded else []

    def merge(self, chosen: list[Part], write_names: Callable[[DataFrame, int], None]) -> Part:
        """One part of the live rows of ``chosen``; ``write_names`` writes names and links from the occurrences it is given."""
        base, number = self.snapshot, self.begin("compact")
        parts = [p.part for p in chosen]
        rest = [n for n in base.numbers() if n not in parts]
        # What is shuffled comes first, while there is no second copy of the texts.
        self.append_postings(self.live("postings", parts=parts), number, self.shares("postings", parts))
        write_names(self.append("occurrences", newest_first(self.live("occurrences", parts=parts)), number), number)
        for name, order in (("documents", ["source", "path"]), ("chunks", CHUNK), ("vectors", CHUNK)):
            # Texts stay where they are read: no key has to come together here, so nothing is shuffled.
            tasks = sum(self.log.size(name, n) for n in parts) // TASK_BYTES + 1
            self.append(name, self.live(name, parts=parts).coalesce(tasks).sortWithinPartitions(*order), number)
        # Retired rows of merged parts are left out by now; the others' are still needed.
        others = self.read("documents", parts=rest).select(F.col("batch").alias("gone_batch"), "doc_id")
        retired = self.append("retired", self.read("retired", parts=parts).join(others, ["gone_batch", "doc_id"], "left_semi"), number)
        layouts: dict[str, list] = {}
        for source, layout in ((s, x) for p in chosen for s, x in p.layouts.items()):
            layouts[source] = max(layouts.get(source, layout), layout)
        merged = Part(
            number, "compact", layouts, chunks=sum(p.chunks - p.gone_chunks for p in chosen),
            words=sum(p.words - p.gone_words for p in chosen), retired=retired.count() if rest else 0)
        self.publish(merged, base, parts)
        return merged

