"""Full-text matching and BM25 ranking.

Two ways to find matches feed one ranking:

* ``scan_matches`` reads texts directly and needs no shuffle: phrase counts and
  document lengths are computed inside each row.
* ``index_matches`` reads a prebuilt postings table, touching only the rows of
  the query's terms.

Both yield one row per matching text with ``dl`` and ``tf`` (one count per
phrase). Collection statistics always describe the whole collection, never the
filtered part of it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import analysis

# Fixed values of the ranking function.
K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
CANDIDATES = 50
KEPT = "_kept"  # whether a row passes the caller's filter
ORDER_DIGITS = 9  # scores are compared at this precision, so ulp noise cannot reorder ties


def _phrase_count(tokens: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    starts = F.when(
        F.size(tokens) >= len(phrase), F.sequence(F.lit(1), F.size(tokens) - len(phrase) + 1)
    ).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        return reduce(and_, [F.get(tokens, i - 1 + j) == word for j, word in enumerate(phrase)])

    return F.size(F.filter(starts, here))


def scan_matches(docs: DataFrame, text: str, phrases: list[list[str]], analyser: str = "porter") -> DataFrame:
    """Every row of ``docs`` with ``dl`` and ``tf``; the text itself is dropped."""
    tokens = docs.withColumn("_words", analysis.words(F.col(text), analyser)).drop(text)
    counts = F.array(*[_phrase_count(F.col("_words"), p) for p in phrases])
    return tokens.withColumn("dl", F.size("_words")).withColumn("tf", counts).drop("_words")


def build_postings(chunks: DataFrame, text: str = "text", analyser: str = "porter") -> DataFrame:
    """One row per (chunk, term): ``term``, ``tf``, ``positions``, ``dl`` and the chunk's columns.

    Words are grouped inside each chunk's own row, so nothing is shuffled here;
    the only shuffle is the caller's, when it lays the postings out by term.
    """
    keep = [c for c in chunks.columns if c != text]
    tokens = chunks.select(*keep, analysis.words(F.col(text), "folded" if analyser == "porter" else analyser)
                           .alias("_words"))
    grouped = tokens.select(
        *keep, F.size("_words").alias("dl"), analysis.term_positions("_words", analyser).alias("_terms")
    )
    # The outer form avoids an inferred filter that would repeat the Arrow function.
    return grouped.select(*keep, "dl", F.inline_outer("_terms")).where("term IS NOT NULL")


def query_postings(postings: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """Only the rows of the query's terms (reaches the scan as an IN filter)."""
    terms = sorted({t for p in phrases for t in p})
    return postings.where(F.col("term").isin(terms))


def index_matches(postings: DataFrame, phrases: list[list[str]], keys: list[str]) -> DataFrame:
    """Rows of ``keys`` with ``dl`` and ``tf`` from postings of the query's terms."""
    rows = query_postings(postings, phrases)
    if len(phrases) == 1 and len(phrases[0]) == 1:
        return rows.select(*keys, "dl", F.array("tf").alias("tf"))
    singles = {p[0] for p in phrases if len(p) == 1}
    placed = {t for p in phrases if len(p) > 1 for t in p}
    aggs = [F.max("dl").alias("dl")]
    aggs += [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"_tf_{t}") for t in sorted(singles)]
    aggs += [
        F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"_pos_{t}") for t in sorted(placed)
    ]
    grouped = rows.groupBy(*keys).agg(*aggs)

    def count(phrase: list[str]) -> Column:
        if len(phrase) == 1:
            return F.coalesce(F.col(f"`_tf_{phrase[0]}`"), F.lit(0))

        def adjacent(start: Column) -> Column:
            return reduce(and_, [
                F.array_contains(F.col(f"`_pos_{word}`"), start + j) for j, word in enumerate(phrase)
            ])

        found = F.size(F.filter(F.col(f"`_pos_{phrase[0]}`"), adjacent))
        return F.greatest(F.coalesce(found, F.lit(0)), F.lit(0))

    return grouped.select(*keys, "dl", F.array(*[count(p) for p in phrases]).alias("tf"))


def index_frequencies(postings: DataFrame, phrases: list[list[str]], keys: list[str]) -> DataFrame:
    """One row with ``df``: per phrase, how many rows of ``keys`` hold it.

    A single word's count is the number of its postings; only phrases of
    several words need their postings brought together.
    """
    rows = query_postings(postings, phrases)
    several = [p for p in phrases if len(p) > 1]
    counts = {p[0]: F.count_if(F.col("term") == p[0]) for p in phrases if len(p) == 1}
    singles = rows.agg(*[c.alias(f"_df_{t}") for t, c in counts.items()] or [F.lit(0).alias("_none")])
    if several:
        together = index_matches(postings, several, keys).agg(document_frequencies(len(several)).alias("df"))
        singles = singles.withColumn("_several", together.scalar())
    placed = iter(range(len(several)))
    ordered = [
        F.col(f"`_df_{p[0]}`") if len(p) == 1 else F.col("_several")[next(placed)] for p in phrases
    ]
    return singles.select(F.array(*ordered).alias("df"))


def collection_stats(matches: DataFrame, n_phrases: int) -> DataFrame:
    """One row: collection size, mean length, and per phrase how many rows hold it.

    ``last`` looks at every column: ranking does so too, and then Spark sees that both read the same exchange.
    """
    return matches.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("dl").alias("avgdl"),
        document_frequencies(n_phrases).alias("df"),
        F.max(F.xxhash64(*matches.columns)).alias("last"),
    )


def document_frequencies(n_phrases: int) -> Column:
    return F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(n_phrases)])


def idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)))
    return F.when(raw > 0, raw).otherwise(F.lit(IDF_FLOOR))


def bm25(tf: Column, dl: Column, n: Column, avgdl: Column, df: Column, n_phrases: int) -> Column:
    """Sum over phrases, left to right; larger is better."""
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / avgdl)
    parts = [
        idf(n, df[i]) * (tf[i] * F.lit(K1 + 1)) / (tf[i] + norm) for i in range(n_phrases)
    ]
    return reduce(lambda a, b: a + b, parts)


def rank_bm25(matches: DataFrame, stats: DataFrame, n_phrases: int, tie: list[str],
              keep: Column | None = None, limit: int | None = CANDIDATES) -> DataFrame:
    """Score rows holding every phrase; filters apply before the limit.

    ``stats`` is one row (``n``, ``avgdl``, ``df``) and reaches the scoring
    expression as a scalar subquery, so no join is planned.
    """
    every = reduce(and_, [F.col("tf")[i] > 0 for i in range(n_phrases)])
    if KEPT in matches.columns:
        every = every & F.col(KEPT)
    if "last" in stats.columns:  # true of every row
        every = every & (F.xxhash64(*matches.columns) <= F.col("_s.last"))
    known = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    chosen = matches if keep is None else matches.where(keep)
    relevance = bm25(
        F.col("tf"), F.col("dl"), F.col("_s.n"), F.col("_s.avgdl"), F.col("_s.df"), n_phrases
    )
    # Rows missing a phrase score NULL. A filter on ``tf`` or ``score`` would be pushed
    # below the projections and tokenise every text again for each use of it: a limited
    # list sorts them last and filters after the limit, an unlimited one filters the
    # output of a one-element explode, which no filter passes.
    known_rows = chosen.withColumn("_s", known)
    score = F.when(every, relevance)
    if limit is None:
        scored = known_rows.select("*", F.explode_outer(F.array(score)).alias("score")).drop("_s")
    else:
        scored = known_rows.withColumn("score", score).drop("_s").orderBy(
            F.round("score", ORDER_DIGITS).desc_nulls_last(), *tie
        ).limit(limit)
    return scored.where(F.col("score").isNotNull()).drop(KEPT)


def search_texts(docs: DataFrame, text: str, query: str, tie: list[str], *, analyser: str = "porter",
                 keep: Column | None = None, limit: int | None = CANDIDATES) -> DataFrame:
    """BM25 top list straight from texts (no index).

    Texts are read and tokenised once: statistics and ranking share one exchange of lengths and counts. A filter
    would be pushed below it and part the two again, so ``keep`` travels as a column.
    """
    phrases = analysis.query_phrases(query, analyser)
    if not phrases:
        return docs.limit(0).drop(text).withColumns(
            {"dl": F.lit(0), "tf": F.array(F.lit(0)), "score": F.lit(0.0)}
        )
    matches = scan_matches(docs, text, phrases, analyser)
    if keep is not None:
        matches = matches.withColumn(KEPT, F.coalesce(keep, F.lit(False)))
    matches = matches.repartition(*tie)
    stats = collection_stats(matches, len(phrases))
    return rank_bm25(matches, stats, len(phrases), tie, limit=limit)
