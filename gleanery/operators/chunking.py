"""Splitting documents into chunks.

Text never leaves the JVM. Spark expressions cut each document into units
(paragraphs, CSV rows, top-level code blocks); one small Arrow function sees
only unit *lengths* and decides which runs of units make a chunk; Spark joins
those runs back into text. No shuffle: one document in, its chunks out.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import text as tx

# Sizes in estimated tokens.
PROSE_TOKENS, PROSE_OVERLAP = 1000, 100
CODE_TOKENS = 1500
_UNBOUNDED = 2**31 - 1
RUNS = T.ArrayType(T.StructType().add("first", T.IntegerType()).add("n", T.IntegerType()))

# A Unicode noncharacter, reserved for exactly this kind of internal marking.
_SECTION_MARK = "\ufdd0"


def layout_for(source_type: Column, path: Column) -> Column:
    """Which splitting rule a document follows."""
    ext = tx.suffix(path)
    return (
        F.when(source_type == "eml_tree", "mail")
        .when(tx.is_commit(path), "whole")
        .when(tx.is_code(path), "code")
        .when(ext == ".csv", "csv")
        .when(ext == ".md", "markdown")
        .otherwise("prose")
    )


def paragraphs(text: Column) -> Column:
    parts = F.split(tx.strip(text), f"\n{tx.ws('*')}\n")
    return F.filter(F.transform(parts, tx.strip), lambda p: p != "")


def sections(text: Column) -> Column:
    """Markdown split before each heading; text before the first one is kept."""
    marked = F.regexp_replace(text, rf"(?dm)^(#{{1,6}}{tx.ws('+')}.*)$", _SECTION_MARK + "$1")
    return F.filter(F.split(marked, _SECTION_MARK), lambda s: tx.strip(s) != "")


def csv_rows(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit("\n")), "\n")


def code_blocks(text: Column, target_chars: int) -> Column:
    """A block starts at every unindented line; oversize blocks fall back to paragraphs."""
    blocks = F.split(F.btrim(text, F.lit("\n")), rf"\n(?!{tx.ws()})(?=[\s\S])")

    def refine(block: Column) -> Column:
        paras = paragraphs(block)
        return F.when(
            (F.length(block) > target_chars) & (F.size(paras) > 0), paras
        ).otherwise(F.array(block))

    return F.when(tx.strip(text) != "", F.flatten(F.transform(blocks, refine)))


def pack(lengths: list[int], target: int, overlap: int, joiner: int) -> list[tuple[int, int]]:
    """Greedy runs (first unit, unit count) whose joined length stays within ``target``.

    A negative length marks a slice of an oversize unit; it stands alone and
    resets the packing. After a full run the next one starts again at the
    shortest tail of it that reaches ``overlap`` without a further unit going
    past it, and always with at least one unit when ``overlap`` is positive.
    The repeated tail is not re-checked, so such a run may exceed ``target``.
    """
    runs: list[tuple[int, int]] = []
    first, size = 0, 0
    for i, n in enumerate(lengths):
        if n < 0:
            if first < i:
                runs.append((first, i - first))
            runs.append((i, 1))
            first, size = i + 1, 0
            continue
        extra = n + (joiner if first < i else 0)
        if first < i and size + extra > target:
            runs.append((first, i - first))
            first, size = _tail(lengths, first, i, overlap, joiner)
            extra = n + (joiner if first < i else 0)
        size += extra
    if first < len(lengths):
        runs.append((first, len(lengths) - first))
    return runs


def _tail(lengths: list[int], low: int, end: int, overlap: int, joiner: int) -> tuple[int, int]:
    if overlap <= 0:
        return end, 0
    start = end - 1
    size = lengths[start]
    while size < overlap and start > low:
        wider = size + joiner + lengths[start - 1]
        if wider > overlap:
            break
        start, size = start - 1, wider
    return start, size


@F.arrow_udf(RUNS)
def _runs(groups: pa.Array, target: pa.Array, overlap: pa.Array, joiner: pa.Array) -> pa.Array:
    out = []
    for nested, *limits in zip(*(column.to_pylist() for column in (groups, target, overlap, joiner))):
        base, found = 0, []
        for lengths in nested or ():
            lengths = lengths or ()
            found += [{"first": base + first, "n": n} for first, n in pack(lengths, *limits)]
            base += len(lengths)
        out.append(found)
    return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())])))


@dataclass(frozen=True)
class Rule:
    """How one kind of text is split: its groups of units (``array<array<string>>``),
    the limits in characters, and what joins units."""

    groups: Column
    target: int
    overlap: int = 0
    joiner: str = "\n\n"
    head: Column | None = None  # repeated at the top of every chunk


def prose_rule(text: Column, markdown: bool = False, target_tokens: int = PROSE_TOKENS,
               overlap_tokens: int = PROSE_OVERLAP) -> Rule:
    if markdown:
        groups = F.transform(sections(tx.strip(text)), paragraphs)
    else:
        groups = F.array(paragraphs(text))
    return Rule(groups, target_tokens * tx.CHARS_PER_TOKEN, overlap_tokens * tx.CHARS_PER_TOKEN)


def csv_rule(text: Column, target_tokens: int = PROSE_TOKENS, overlap_tokens: int = PROSE_OVERLAP) -> Rule:
    """Every chunk repeats the first row; no quoting awareness."""
    rows = csv_rows(text)
    data = F.filter(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda r: r != "")
    return Rule(
        F.array(data), target_tokens * tx.CHARS_PER_TOKEN, overlap_tokens * tx.CHARS_PER_TOKEN, "\n",
        F.element_at(rows, 1),
    )


def code_rule(text: Column, target_tokens: int = CODE_TOKENS) -> Rule:
    target = target_tokens * tx.CHARS_PER_TOKEN
    return Rule(F.array(code_blocks(text, target)), target)


def whole_rule(text: Column) -> Rule:
    body = tx.strip(text)
    return Rule(F.when(body != "", F.array(F.array(body))), _UNBOUNDED)


def add_bodies(docs: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Add ``bodies``, the chunk bodies of each document, under the rule its ``layout`` names.

    One pass whatever the mix of layouts. Units longer than the target are cut
    into target-size slices first. Groups are packed one by one, so neither a
    chunk nor an overlap crosses a group.
    """
    def pick(of) -> Column:
        return F.coalesce(*[F.when(F.col("layout") == name, of(rule)) for name, rule in rules.items()])

    ruled = docs.withColumns({
        "_groups": pick(lambda r: r.groups),
        "_head": pick(lambda r: r.head if r.head is not None else F.lit(None).cast("string")),
        "_target": pick(lambda r: F.lit(r.target)),
        "_overlap": pick(lambda r: F.lit(r.overlap)),
        "_joiner": pick(lambda r: F.lit(r.joiner)),
    })
    slice_pattern = F.concat(F.lit("([\\s\\S]{1,"), F.col("_target").cast("string"), F.lit("})"))

    def cut(unit: Column) -> Column:
        return F.when(
            F.length(unit) > F.col("_target"), F.regexp_extract_all(unit, slice_pattern, 1)
        ).otherwise(F.array(unit))

    def signed(slices: Column) -> Column:
        return F.when(
            F.size(slices) > 1, F.transform(slices, lambda s: -F.length(s))
        ).otherwise(F.transform(slices, F.length))

    cuts = ruled.withColumn("_pieces", F.transform("_groups", lambda g: F.transform(g, cut)))
    lengths = F.transform("_pieces", lambda g: F.flatten(F.transform(g, signed)))
    planned = cuts.withColumn("_runs", _runs(lengths, F.col("_target"), F.col("_overlap"), F.length("_joiner")))

    def joined(units: Column) -> Column:
        return F.transform(
            "_runs",
            lambda r: F.call_function("array_join", F.slice(units, r["first"] + 1, r["n"]), F.col("_joiner")),
        )

    def headed(head: Column) -> Column:
        return (
            F.when(head == "", F.array().cast("array<string>"))
            .when(F.size("_joined") == 0, F.array(head))
            .otherwise(F.transform("_joined", lambda b: F.concat(head, F.lit("\n"), b)))
        )

    texts = planned.withColumn("_joined", tx.let(F.flatten(F.flatten("_pieces")), joined))
    bodies = F.when(F.col("_head").isNull(), F.col("_joined")).otherwise(tx.let(F.col("_head"), headed))
    helpers = ("_groups", "_head", "_target", "_overlap", "_joiner", "_pieces", "_runs", "_joined")
    return texts.withColumn("bodies", bodies).drop(*helpers)


def _by(docs: DataFrame, rule: Rule) -> DataFrame:
    return add_bodies(docs.withColumn("layout", F.lit("only")), {"only": rule}).drop("layout")


def chunk_prose(docs: DataFrame, text: Column, **limits) -> DataFrame:
    return _by(docs, prose_rule(text, **limits))


def chunk_csv(docs: DataFrame, text: Column, **limits) -> DataFrame:
    return _by(docs, csv_rule(text, **limits))


def chunk_code(docs: DataFrame, text: Column, **limits) -> DataFrame:
    return _by(docs, code_rule(text, **limits))


def chunk_whole(docs: DataFrame, text: Column) -> DataFrame:
    return _by(docs, whole_rule(text))


def explode_chunks(docs: DataFrame, header: Column, lead: Column | None = None) -> DataFrame:
    """One row per chunk: ``seq`` and ``text`` = header, blank line, body.

    ``lead`` is an optional body placed before all others (NULL for none).
    """
    extra = F.when(lead.isNotNull(), F.array(lead)) if lead is not None else None
    nothing = F.array().cast("array<string>")
    every = F.coalesce("bodies", nothing)
    if extra is not None:
        every = F.concat(F.coalesce(extra, nothing), every)
    labelled = tx.let(header, lambda h: F.transform(every, lambda b: F.concat(h, F.lit("\n\n"), b)))
    keep = [c for c in docs.columns if c not in ("bodies", "text")]
    # The outer form, because for the plain one the optimizer infers a filter that
    # repeats the whole expression, Arrow function included.
    return docs.select(*keep, F.posexplode_outer(labelled).alias("seq", "text")).where("seq IS NOT NULL")


def chunk_by_layout(docs: DataFrame, header: Column, lead: Column | None = None) -> DataFrame:
    """Chunk documents of mixed kinds; needs columns ``layout`` and ``text``.

    Mail without a text still yields its lead chunk; other documents without
    one yield nothing.
    """
    text = F.col("text")
    rules = {
        "mail": prose_rule(text),
        "prose": prose_rule(text),
        "markdown": prose_rule(text, markdown=True),
        "csv": csv_rule(text),
        "code": code_rule(text),
        "whole": whole_rule(text),
    }
    return explode_chunks(add_bodies(docs, rules), header, lead)


def reconstruct(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Document content: its chunk texts in ``seq`` order, blank-line separated."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return chunks.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda c: c["text"]), "\n\n").alias("content")
    )
