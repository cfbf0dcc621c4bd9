"""The analyser, ranking and snippets against SQLite's FTS5, which is independent of both."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from gleanery.functions import analysis
from gleanery.functions.snippet import snippet
from gleanery.operators import lexical

TEXTS = [
    "The invoiced amount was paid. Invoicing again: relational databases hopefully adjustable.",
    "Étude für straße naïve façade, Ångström. CAFÉ café café x_y foo_bar",
    "foo bar baz foo_bar bar foo. A sentence: foo bar ends here. And more words follow the end of this one now.",
    "caresses ponies ties cats agreed feed plastered motoring sing conflated troubled sized hopping tanned falling",
    "hissing fizzed failing filing happy sky say toys syzygy controlling rolled generalizations oscillators",
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen lighthouse fifteen sixteen",
    "½ ² ٣ INV-2024-0312 a1b2 don't e-mail user@example.org",
    "alpha beta. gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi lighthouse omicron pi rho sigma "
    "tau upsilon phi chi psi omega lighthouse foo again and again until the very end of the text comes",
    "", "   ", "foo", "cafe\u0301s nai\u0308ve \u0301x a\u0301\u0302b \u0130stanbul x\u0301", "\ue000private \u0301 marks",
] + [f"filler document number {i} with shared words and item{i % 7}" + " foo" * (i % 4) for i in range(40)]

QUERIES = ["foo", "foo bar", "foo_bar", "invoice", "lighthouse", "cafe", "CAFÉ", "item3 shared", "INV-2024-0312",
           "foo foo", "generalization", "foo lighthouse", "with", "don't", "nothing_here zebra"]


@pytest.fixture(scope="module")
def fts():
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no FTS5")
    db.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", list(enumerate(TEXTS, start=1)))
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    return db


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS, start=1)), "id long, text string").cache()


def quoted(query):
    return " ".join('"' + " ".join(run.split("_")) + '"' for run in __import__("re").findall(r"\w+", query))


def test_terms_and_positions(fts, texts):
    expected = {}
    for term, doc, place in fts.execute("SELECT term, doc, offset FROM v"):
        expected.setdefault((doc, term), []).append(place)
    found = {(r.id, r.term): list(r.positions) for r in lexical.build_postings(texts).collect()}
    assert found == expected


def test_word_count_is_the_number_of_terms(texts):
    both = texts.select(analysis.word_count(F.col("text")).alias("a"), F.size(analysis.words(F.col("text"), "porter")).alias("b"))
    assert all(r.a == r.b for r in both.collect())


@pytest.mark.parametrize("query", QUERIES)
def test_ranking(fts, texts, query):
    expected = dict(fts.execute("SELECT rowid, -bm25(t) FROM t WHERE t MATCH ?", [quoted(query)]).fetchall())
    scanned = lexical.search_texts(texts, "text", query, ["id"], limit=None).collect()
    assert {r.id: r.score for r in scanned} == pytest.approx(expected, rel=1e-12)
    top = lexical.search_texts(texts, "text", query, ["id"], limit=5).collect()
    best = sorted(expected, key=lambda i: (-round(expected[i], 9), i))[:5]
    assert [r.id for r in top] == best


@pytest.mark.parametrize("query", ["foo", "foo bar", "foo_bar", "item3 shared", "foo foo_bar foo"])
def test_index_and_scan_agree(texts, query):
    phrases = analysis.query_phrases(query)
    from_index = lexical.index_matches(lexical.build_postings(texts), phrases, ["id"])
    scanned = lexical.scan_matches(texts, "text", phrases).select("id", "dl", "tf")
    assert {tuple(map(str, r)) for r in from_index.collect() if any(r.tf)} == {
        tuple(map(str, r)) for r in scanned.collect() if any(r.tf)
    }


@pytest.mark.parametrize("query", QUERIES)
def test_snippets(fts, texts, query):
    rows = fts.execute("SELECT rowid, snippet(t, 0, '', '', ' ... ', 12) FROM t WHERE t MATCH ?", [quoted(query)])
    expected = dict(rows.fetchall())
    mine = texts.where(F.col("id").isin([*expected, -1])).select("id", snippet(F.col("text"), analysis.query_phrases(query)).alias("s"))
    assert {r.id: r.s for r in mine.collect()} == expected


@pytest.mark.parametrize("query", ["", "   ", "----", "_", "* ( wildcard", '"unterminated', "foo AND (bar", 'NEAR("x)'])
def test_hostile_queries_never_fail(texts, query):
    lexical.search_texts(texts, "text", query, ["id"]).collect()


def test_queries_without_words_match_nothing(texts):
    for query in ("", "----", "_"):
        assert lexical.search_texts(texts, "text", query, ["id"]).count() == 0


def test_filter_narrows_results_but_not_statistics(texts):
    everywhere = {r.id: r.score for r in lexical.search_texts(texts, "text", "foo", ["id"], limit=None).collect()}
    some = {r.id: r.score for r in lexical.search_texts(texts, "text", "foo", ["id"], keep=F.col("id") > 20, limit=None).collect()}
    assert some == {i: s for i, s in everywhere.items() if i > 20}
