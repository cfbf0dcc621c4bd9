"""Best hits of long posting lists without reading all of them.

Postings are laid out by term and span, a run of neighbouring documents. For every long list, ``blocks`` has the largest
count and the shortest text of each span, from which follows a bound of the scores there. The spans with the best bounds are scored first;
their 50th score rules out every span whose bound is lower, and what is left is read by span, so that row groups are skipped.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators import lexical
from gleanery.plans.index import CHUNK, Index, blocks_of

FIRST_SPANS = 64
#: Spans that are named in a filter; if more may hold a hit, all are read.
MOST_SPANS = 10_000
#: Bounds are computed in another order than scores, and scores are compared at nine decimals.
SLACK = 1e-8


def term_blocks(index: Index, terms: list[str]) -> DataFrame | None:
    """term, batch, span, n, max_tf, min_dl of the terms in all parts; None if no list is long."""
    known = index.read("blocks", F.col("term").isin(terms))
    long = {(r.part, r.term) for r in known.select("part", "term").distinct().collect()}  # parts x terms
    if not long:
        return None
    columns = ["term", "batch", "span", "n", "max_tf", "min_dl"]
    found = [known.select(*columns)]
    for part in index.snapshot.numbers():
        short = [t for t in terms if (part, t) not in long]
        if short:
            found.append(blocks_of(index.read("postings", F.col("term").isin(short), [part])).select(*columns))
    return reduce(DataFrame.unionByName, found)


def pruned_scores(index: Index, terms: list[str], keep: Column | None, limit: int) -> DataFrame | None:
    """What ``lexical_scores`` gives for single words; None where reading everything is as good.

    Lists with retired rows are read whole: their blocks would count rows that are gone.
    """
    totals = index.totals()
    blocks = None if totals.retired else term_blocks(index, terms)
    if blocks is None:
        return None
    n, avgdl = totals.chunks, totals.words / max(totals.chunks, 1)
    df = {r.term: r.n for r in blocks.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    counts = [df.get(t, 0) for t in terms]
    stats = index.spark.createDataFrame([(n, avgdl, counts)], "n long, avgdl double, df array<long>")

    def best(tf: str, dl: str, at: int) -> Column:
        return lexical.bm25(F.array(tf), F.col(dl), F.lit(n), F.lit(avgdl), F.array(F.lit(counts[at])), 1)

    bound = reduce(add, [F.coalesce(F.max(F.when(F.col("term") == t, best("max_tf", "min_dl", i))), F.lit(0.0)) for i, t in enumerate(terms)])
    spans = blocks.groupBy("batch", "span").agg(bound.alias("bound"), F.count_distinct("term").alias("terms"))
    spans = spans.where(F.col("terms") == len(terms))
    first = spans.orderBy(F.col("bound").desc(), "batch", "span").limit(FIRST_SPANS).collect()
    scored = _scores(index, terms, stats, keep, limit, first).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
    left = spans if scored.n < limit else spans.where(F.col("bound") >= scored.least - SLACK)
    chosen = left.limit(MOST_SPANS + 1).collect()
    return _scores(index, terms, stats, keep, limit, chosen if len(chosen) <= MOST_SPANS else None)


def _scores(index: Index, terms: list[str], stats: DataFrame, keep: Column | None, limit: int, spans: list | None) -> DataFrame:
    """The best chunks of some spans, or of all."""
    where = [F.col("term").isin(terms)]
    if spans is not None:
        where += [F.col("batch").isin(sorted({s.batch for s in spans})), F.col("span").isin(sorted({s.span for s in spans}))]
    rows = index.read("postings", reduce(and_, where))
    phrases = [[t] for t in terms]
    matches = lexical.index_matches(rows, phrases, [*CHUNK, "source", "doc_date"])
    return lexical.rank_bm25(matches, stats, len(terms), ["source", *CHUNK], keep, limit)
