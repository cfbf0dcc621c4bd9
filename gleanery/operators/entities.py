"""People, organisations and categories found in documents, and their links.

Every occurrence becomes one row: ``doc_id, kind, key, rel, display, at`` where
``at`` orders occurrences (source, path, position). Entities, document edges
and entity links are aggregations of those rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import addresses as ad
from gleanery.functions import windows as win
from gleanery.operators.sizing import bounded

# Relation names and the order in which kinds answer to a key.
MAIL_FIELDS = ("from", "to", "cc", "bcc", "reply_to")
KIND_PRIORITY = ("email", "person", "org", "category")
CORRESPONDENT_RELS = ("from", "to", "cc")

OCCURRENCE = ["doc_id", "kind", "key", "rel", "display", "at"]
#: Mentions stand behind all other occurrences of a document.
MENTIONS_FROM = 1 << 30
#: Seed names that may travel through the driver, and those of one automaton, which every task holds; in characters of all names.
SEED_CHARS, AUTOMATON_CHARS = 1 << 26, 1 << 20


@dataclass(frozen=True)
class Seeds:
    persons: tuple[str, ...] = ()
    orgs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Aliases:
    """``alias_of``: address -> person name; ``member_of``: person name -> organisation."""

    alias_of: dict[str, str] = field(default_factory=dict)
    member_of: dict[str, str] = field(default_factory=dict)


def _position(*parts: Column) -> Column:
    return F.struct(F.col("source"), F.col("path"), *parts)


def _document(docs: DataFrame) -> list[str]:
    """What occurrences take over from their document; its date only where it is known."""
    return ["doc_id", *[c for c in ("doc_date",) if c in docs.columns]]


def mail_occurrences(docs: DataFrame, fields: tuple[str, ...] = MAIL_FIELDS) -> DataFrame:
    """Addresses of mail documents: ``doc_id, source, path`` plus one column per header field.

    Items of plain headers become rows before they are taken apart, so that Spark compiles what is done to each.
    """
    kinds = {f.name: f.dataType for f in docs.schema}
    kept = [*_document(docs), "source", "path"]
    texts = [f for f in fields if isinstance(kinds[f], T.StringType)]
    # One select each, so that nothing is worked out twice: what is plain, the lists, all in one list, its rows, their parts.
    looked_at = docs.select(*kept, *[F.col(f"`{f}`") for f in fields], *[ad.is_plain(F.col(f"`{f}`")).alias(f"{f} plain") for f in texts])

    def items(field: str) -> Column:
        """``array<struct<item, who>>``: items of a plain header, or addresses that are parsed already."""
        header, none = F.col(f"`{field}`"), F.array().cast("array<string>")
        if field not in texts:
            return F.arrays_zip(none.alias("item"), F.coalesce(ad.address_list(header, kinds[field]), F.array().cast(T.ArrayType(ad.ADDRESS))).alias("who"))
        plain = F.col(f"`{field} plain`")
        parsed = ad.parse_odd(F.when(~plain, header))
        return F.arrays_zip(F.when(plain, ad.plain_items(header)).otherwise(none).alias("item"), parsed.alias("who"))

    lists = looked_at.select(*kept, *[items(f).alias(f) for f in fields])
    sizes = [F.size(F.col(f"`{f}`")) for f in fields]
    rows = lists.select(
        *kept, *[sum(sizes[1:i], sizes[0]).alias(f"{f} end") for i, f in enumerate(fields, 1)],
        F.posexplode_outer(F.concat(*[F.col(f"`{f}`") for f in fields])).alias("n", "a"),
    ).where("a IS NOT NULL")
    address, name = ad.plain_parts(F.col("a.item"))
    rel = F.coalesce(*[F.when(F.col("n") < F.col(f"`{f} end`"), F.lit(f)) for f in fields])
    plain = F.col("a.item").isNotNull()
    parts = rows.select(
        *kept, "n", rel.alias("rel"), F.when(plain, address).otherwise(F.col("a.who.address")).alias("address"),
        F.when(plain, name).otherwise(F.coalesce("a.who.name", F.lit(""))).alias("name"))
    return parts.select(
        *_document(docs),
        F.lit("email").alias("kind"),
        ad.email_key(F.col("address")).alias("key"),
        "rel",
        F.when(F.col("name") != "", F.col("name")).otherwise(F.col("address")).alias("display"),
        _position(F.col("n")).alias("at"),
    )


def person_occurrences(docs: DataFrame, rel: str, email: str, name: str, n: int) -> DataFrame:
    """One address column and one name column (commit authors and committers)."""
    address = F.col(email)
    return docs.where(F.coalesce(address, F.lit("")) != "").select(
        *_document(docs),
        F.lit("email").alias("kind"),
        ad.email_key(address).alias("key"),
        F.lit(rel).alias("rel"),
        F.coalesce(F.when(F.col(name) != "", F.col(name)), address).alias("display"),
        _position(F.lit(n).alias("n")).alias("at"),
    )


def category_occurrences(docs: DataFrame) -> DataFrame:
    first = ad.category(F.col("path"))
    return docs.where(first.isNotNull()).select(
        *_document(docs),
        F.lit("category").alias("kind"),
        ad.slug(first).alias("key"),
        F.lit("category").alias("rel"),
        first.alias("display"),
        _position(F.lit(0).alias("n")).alias("at"),
    )


@dataclass(frozen=True)
class Names:
    """Seed names as one automaton, so that a text is read once however many names there are."""

    needles: tuple[str, ...]

    def automaton(self) -> ahocorasick.Automaton:
        places: dict[str, list[int]] = {}
        for n, needle in enumerate(self.needles):
            if needle:
                places.setdefault(needle, []).append(n)
        made = ahocorasick.Automaton()
        for needle, found in places.items():
            made.add_word(needle, found)
        made.make_automaton()
        return made

    def found_in(self) -> Callable[[Column], Column]:
        """The sorted places of the names that a text contains."""
        everywhere = [n for n, needle in enumerate(self.needles) if not needle]

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def places(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            names = self.automaton()
            for column in texts:
                yield pa.array([
                    sorted({*everywhere, *(n for _, found in (names.iter(t) if len(names) else ()) for n in found)})
                    for t in column.to_pylist()], pa.list_(pa.int32()))

        return places


def _haystack() -> Column:
    def shown(c: str) -> Column:
        return F.when(F.col(c) != "", F.col(c))

    return F.lower(F.concat_ws("\n", shown("title"), shown("path")))


def _mentions(hits: DataFrame, kept: list[str]) -> DataFrame:
    return hits.select(
        *kept,
        "kind",
        ad.slug(F.col("name")).alias("key"),
        F.lit("mentions").alias("rel"),
        F.col("name").alias("display"),
        _position((F.col("n") + F.lit(MENTIONS_FROM)).alias("n")).alias("at"),
    )


def mention_occurrences(docs: DataFrame, seeds: Seeds) -> DataFrame:
    """Seed names found, ignoring case, in the title or path of a document.

    The names travel to the tasks with the function, whence SEED_CHARS; they are not part of the plan.
    More names than one automaton takes are a table.
    """
    named = [("person", n) for n in seeds.persons if n] + [("org", n) for n in seeds.orgs if n]
    chars = sum(len(name) for _, name in named)
    if chars > SEED_CHARS:
        raise ValueError(f"the seed names are longer than {SEED_CHARS} characters in all")
    spelled = docs.sparkSession.createDataFrame(
        [(n, kind, name) for n, (kind, name) in enumerate(named)], "n int, kind string, name string")
    if chars > AUTOMATON_CHARS:
        return mentions_in_table(docs, spelled)
    found_in = Names(tuple(name.strip().lower() for _, name in named)).found_in()
    kept = _document(docs)
    hits = docs.select(*kept, "source", "path", found_in(_haystack()).alias("ns"))
    # The outer form avoids an inferred filter that would repeat the Arrow function.
    hits = hits.select(*kept, "source", "path", F.explode_outer("ns").alias("n")).where("n IS NOT NULL")
    return _mentions(hits.join(bounded(spelled, len(named)), "n"), kept)


@F.arrow_udf(T.StringType())
def _needle(names: pa.Array) -> pa.Array:
    return pa.array([name.strip().lower() for name in names.to_pylist()], pa.string())


def mentions_in_table(docs: DataFrame, names: DataFrame) -> DataFrame:
    """The same for any number of seed names: rows ``n, kind, name``.

    Names stay where they are: tasks hold a bitmap of fixed size, and the parts of texts that pass it meet the names in a join.
    """
    spelled = names.where(F.col("name") != "").select("n", "kind", "name", _needle("name").alias("needle"))
    known = win.bitmap(spelled, "needle")
    kept = _document(docs)
    hits = docs.select(*kept, "source", "path", win.windows(_haystack(), known).alias("windows"))
    hits = hits.select(*kept, "source", "path", F.explode_outer("windows").alias("window")).where("window IS NOT NULL")
    return _mentions(hits.join(spelled, F.col("window") == F.col("needle").cast("binary")), kept)


def occurrences(docs: DataFrame, seeds: Seeds) -> DataFrame:
    """All occurrences of typed documents.

    ``docs`` has ``doc_id, source, path, title, doc_kind`` ('mail', 'commit' or
    'file') and ``meta`` with the mail and author fields.
    """
    meta = docs.select(*_document(docs), "source", "path", "title", "doc_kind", "meta.*")
    mail = meta.where("doc_kind = 'mail'")
    commit = meta.where("doc_kind = 'commit'")
    parts = [
        mail_occurrences(mail),
        person_occurrences(commit, "author", "author_email", "author_name", 0),
        person_occurrences(commit, "committer", "committer_email", "committer_name", 1),
        category_occurrences(meta.where("doc_kind = 'file'")),
        mention_occurrences(meta, seeds),
    ]
    return reduce(DataFrame.unionByName, parts)


def document_edges(found: DataFrame) -> DataFrame:
    """Distinct ``doc_id, kind, key, rel``."""
    return found.select("doc_id", "kind", "key", "rel").distinct()


def name_votes(found: DataFrame) -> DataFrame:
    """How often, and where first, each spelling of an entity was seen.

    Aggregates before shuffling, so a key holding a third of all rows reaches
    its reducer as one row per task and spelling.
    """
    return found.groupBy("kind", "key", "display").agg(
        F.count(F.lit(1)).alias("votes"), F.min("at").alias("at")
    )


def entities(votes: DataFrame) -> DataFrame:
    """``kind, key, display``; kind and key together identify an entity.

    An address shows its most frequent spelling, the first seen among equals;
    everything else shows the spelling it was first created with.
    """
    merged = votes.groupBy("kind", "key", "display").agg(
        F.sum("votes").alias("votes"), F.min("at").alias("at")
    )
    weight = F.when(F.col("kind") == "email", -F.col("votes")).otherwise(F.lit(0))
    return merged.groupBy("kind", "key").agg(
        F.min_by("display", F.struct(weight, F.col("at"), F.col("display"))).alias("display")
    )


def _pairs(spark: SparkSession, mapping: dict[str, str], normalise) -> DataFrame:
    """``alias, name`` with normalised aliases; the last of equal ones wins."""
    rows = [(i, raw, name) for i, (raw, name) in enumerate(mapping.items())]
    table = spark.createDataFrame(rows, "n long, raw string, name string")
    return table.groupBy(normalise(F.col("raw")).alias("alias")).agg(F.max_by("name", "n").alias("name"))


def alias_tables(spark: SparkSession, aliases: Aliases) -> tuple[DataFrame, DataFrame]:
    """(email key -> person name), (person key -> organisation name)."""
    persons = _pairs(spark, aliases.alias_of, ad.email_key)
    orgs = _pairs(spark, aliases.member_of, ad.slug)
    return (
        persons.select(F.col("alias").alias("email"), F.col("name").alias("person")),
        orgs.select(F.col("alias").alias("member"), F.col("name").alias("org")),
    )


def linked(votes: DataFrame, aliases: Aliases) -> tuple[DataFrame, DataFrame]:
    """(links, extra votes): entities reached through aliases.

    Links are ``a_kind, a_key, rel, b_kind, b_key``: 'alias_of' from an address to its person and
    'member_of' from a person to its organisation. The extra votes create the
    persons and organisations that only aliases name.
    """
    spark = votes.sparkSession
    person_of, org_of = alias_tables(spark, aliases)
    seen = votes.groupBy("kind", "key").agg(F.min("at").alias("at"))
    aliased = seen.where("kind = 'email'").join(
        bounded(person_of, len(aliases.alias_of)), F.col("key") == F.col("email")
    ).select("key", "at", "person", ad.slug(F.col("person")).alias("person_key"))
    people = seen.where("kind = 'person'").select("key", "at").unionByName(
        aliased.select(F.col("person_key").alias("key"), "at")
    )
    members = people.join(
        bounded(org_of, len(aliases.member_of)), F.col("key") == F.col("member")
    ).select("key", "at", "org", ad.slug(F.col("org")).alias("org_key"))
    links = aliased.select(
        F.lit("email").alias("a_kind"), F.col("key").alias("a_key"), F.lit("alias_of").alias("rel"),
        F.lit("person").alias("b_kind"), F.col("person_key").alias("b_key"),
    ).unionByName(members.select(
        F.lit("person").alias("a_kind"), F.col("key").alias("a_key"), F.lit("member_of").alias("rel"),
        F.lit("org").alias("b_kind"), F.col("org_key").alias("b_key"),
    )).distinct()
    extra = aliased.select(
        F.lit("person").alias("kind"), F.col("person_key").alias("key"),
        F.col("person").alias("display"), F.lit(0).cast("long").alias("votes"), "at",
    ).unionByName(members.select(
        F.lit("org").alias("kind"), F.col("org_key").alias("key"),
        F.col("org").alias("display"), F.lit(0).cast("long").alias("votes"), "at",
    ))
    return links, extra


def find(known: DataFrame, key: str, kind: str | None = None) -> DataFrame:
    """Entities answering to ``key``, best kind first."""
    match = known.where(F.col("key") == key)
    if kind:
        match = match.where(F.col("kind") == kind)
    rank = F.coalesce(
        *[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KIND_PRIORITY)],
        F.lit(len(KIND_PRIORITY)),
    )
    return match.withColumn("_rank", rank).orderBy("_rank", "kind").drop("_rank")


def _is(end: str, kind: str, key: str) -> Column:
    return (F.col(f"{end}_kind") == kind) & (F.col(f"{end}_key") == key)


def _ends(links: DataFrame, mine: Column, other: str) -> DataFrame:
    return links.where(mine).select(
        "rel", F.col(f"{other}_kind").alias("kind"), F.col(f"{other}_key").alias("key")
    )


def directed_links(links: DataFrame, known: DataFrame, kind: str, key: str) -> DataFrame:
    """Both directions listed on their own; a link to itself appears in each."""
    out = _ends(links, _is("a", kind, key), "b").withColumn("direction", F.lit("out"))
    back = _ends(links, _is("b", kind, key), "a").withColumn("direction", F.lit("in"))
    return out.unionByName(back).join(known, ["kind", "key"]).select(
        "direction", "rel", "kind", "key", "display"
    )


def neighbours(links: DataFrame, known: DataFrame, kind: str, key: str) -> DataFrame:
    """The other end of every link of an entity; a link to itself counts once.

    Two equality filters instead of one OR, so both can use pruned scans.
    """
    out = _ends(links, _is("a", kind, key), "b")
    back = _ends(links, _is("b", kind, key) & ~_is("a", kind, key), "a")
    return out.unionByName(back).join(known, ["kind", "key"]).select("rel", "kind", "key", "display")


def both_ends(links: DataFrame) -> DataFrame:
    """Every link listed at either end: ``end, kind, key, rel, other_kind, other_key``; ``end`` is the link's side, a or b."""
    def seen_from(end: str, other: str) -> Column:
        return F.struct(
            F.lit(end).alias("end"), F.col(f"{end}_kind").alias("kind"), F.col(f"{end}_key").alias("key"), "rel",
            F.col(f"{other}_kind").alias("other_kind"), F.col(f"{other}_key").alias("other_key"))

    return links.select(F.inline(F.array(seen_from("a", "b"), seen_from("b", "a"))))


def from_ends(ends: DataFrame) -> DataFrame:
    """The distinct links of such rows."""
    a = F.col("end") == "a"
    return ends.select(
        *[F.when(a, F.col(c)).otherwise(F.col(f"other_{c}")).alias(f"a_{c}") for c in ("kind", "key")], "rel",
        *[F.when(a, F.col(f"other_{c}")).otherwise(F.col(c)).alias(f"b_{c}") for c in ("kind", "key")]).distinct()


def newest_documents(edges: DataFrame, documents: DataFrame, kind: str, key: str, limit: int = 20,
                     on: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    mine = edges.where((F.col("kind") == kind) & (F.col("key") == key)).select(*on, "rel")
    return (
        documents.join(mine, list(on))
        .orderBy(F.col("doc_date").desc_nulls_last(), "source", "path", "rel")
        .limit(limit)
        .select("source", "path", "title", "doc_date", "rel")
    )


def documents_per_address(edges: DataFrame, rels: dict[str, tuple[str, ...]], on: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``key`` and, for each name of ``rels``, how many distinct documents an address has over those relations.

    One pass: a document's relations to an address become flags, which are then added up per address.
    """
    mine = edges.where((F.col("kind") == "email") & F.col("rel").isin(sorted({r for rs in rels.values() for r in rs})))
    flags = mine.groupBy("key", *on).agg(*[F.max(F.col("rel").isin(*rs)).alias(name) for name, rs in rels.items()])
    return flags.groupBy("key").agg(*[F.count_if(F.col(name)).alias(name) for name in rels])


def alias_review(edges: DataFrame, known: DataFrame, top_n: int = 200,
                 on: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Top correspondents plus every commit author: ``key, display, n, tags``."""
    counted = documents_per_address(edges, {"corresponded": CORRESPONDENT_RELS, "committed": ("author",)}, on)
    top = (
        counted.where("corresponded > 0").orderBy(F.col("corresponded").desc(), "key").limit(top_n)
        .select("key", F.lit(True).alias("top"))
    )
    chosen = counted.join(F.broadcast(top), "key", "left").where("top OR committed > 0")  # ``top_n`` rows
    tags = F.concat_ws("+", F.when(F.col("top"), "correspondent"), F.when(F.col("committed") > 0, "git author"))
    names = known.where("kind = 'email'").select("key", "display")
    return chosen.join(names, "key").select(
        "key",
        F.coalesce("display", "key").alias("display"),
        F.when(F.col("top"), F.col("corresponded")).otherwise(F.col("committed")).alias("n"),
        tags.alias("tags"),
    ).orderBy(F.col("n").desc(), "key")
