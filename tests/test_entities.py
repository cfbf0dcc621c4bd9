"""Addresses, occurrences, names, links and cards on small tables."""

import random
from email.utils import getaddresses

import pytest
from pyspark.sql import functions as F

from gleanery.functions import addresses
from gleanery.operators import entities
from gleanery.operators.entities import Aliases, Seeds
from gleanery.sources import names

HEADERS = [
    "a@b.c", "Jane Roe <jane@x.y>", '"Roe, Jane" <jane@x.y>, bob@z.w', "Bob  B. <b@z.w> , c@d.e", "", " ", ",", "a@b, ,c@d",
    "no address", "Jane (comment) <j@x>", "group: a@b, c@d;", "<only@angle.x>", "é Ü <e@u.x>", "x@y, broken <", "a@b@c",
    "Jane\tTab <j@t.x>", "J. R. O'Neil-Smith <j+tag@x.y>", "'quoted' <q@x.y>", "a b@c.d", "Name <a@b.c> trailing",
    "=?utf-8?q?Zo=C3=AB?= <z@q.x>", "Customer#1 <c.1+5@SEG.example.com>", "many@x.y," * 3 + "last@x.y", "A <a@[1.2.3.4]>",
]


def by_stdlib(header):
    return [(a.strip(), n.strip() or None) for n, a in getaddresses([header]) if a]


def parsed(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, h string")
    out = rows.select("i", addresses.parse_header(F.col("h")).alias("o")).orderBy("i").collect()
    return [[tuple(a) for a in r.o] for r in out]


def test_headers_parse_as_the_standard_library_does(spark):
    assert parsed(spark, HEADERS) == [by_stdlib(h) for h in HEADERS]


def test_random_headers(spark):
    rng = random.Random(1)
    values = ["".join(rng.choices("ab.é +-_#'@<>,;:\"()\\ \t", k=rng.randint(0, 25))) for _ in range(20_000)]
    assert parsed(spark, values) == [by_stdlib(h) for h in values]


def test_random_lists(spark):
    rng = random.Random(2)
    parts = ["a@b", "N <c@d>", " x  y <e.f@g-h>", "<i@j>", "k", "l@", "<m@n", ". <o@p>", "q@r.s ", "J. R. <t@u>", "v..w@x"]
    values = [",".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(5000)]
    assert parsed(spark, values) == [by_stdlib(h) for h in values]


@pytest.fixture(scope="module")
def docs(spark):
    meta = """struct<from:string,to:string,cc:string,bcc:string,reply_to:string,author_name:string,author_email:string,
        committer_name:string,committer_email:string>"""
    return spark.createDataFrame([
        (1, "mail", "2024/1/1/a.eml", "Hello Acme Corp", "mail",
         ("Jane <Jane+x@E.org>", "bob@e.org, Bob <bob@e.org>", None, "hid@e.org", "desk@e.org", None, None, None, None)),
        (2, "mail", "2024/1/2/b.eml", "Re", "mail", ("J. Roe <jane@e.org>", None, "bob@e.org", None, None, None, None, None, None)),
        (3, "mail", "2024/1/3/c.eml", None, "mail", ("J. Roe <jane@e.org>", None, None, None, None, None, None, None, None)),
        (4, "repo", "commit/1", "Fix", "commit", (None, None, None, None, None, "Jane", "jane@e.org", "Rob", "rob@e.org")),
        (5, "repo", "src/x.py", "x.py", "file", None),
        (6, "files", "Jane Roe/acme corp.txt", "acme corp.txt", "file", None),
        (7, "files", "top.txt", "top.txt", "file", None),
    ], f"doc_id long, source string, path string, title string, doc_kind string, meta {meta}")


SEEDS = Seeds(persons=("Jane Roe ", ""), orgs=("ACME Corp",))
ALIASES = Aliases({"Jane@E.org": "Jane Roe", "jane+z@e.org": "Jane Q. Roe"}, {"Jane q Roe": "Acme, Inc."})


def test_occurrences(docs):
    found = {(r.doc_id, r.kind, r.key, r.rel) for r in entities.document_edges(entities.occurrences(docs, SEEDS)).collect()}
    assert found == {
        (1, "email", "jane@e.org", "from"), (1, "email", "bob@e.org", "to"), (1, "email", "hid@e.org", "bcc"),
        (1, "email", "desk@e.org", "reply_to"), (1, "org", "acme corp", "mentions"), (2, "email", "jane@e.org", "from"),
        (2, "email", "bob@e.org", "cc"), (3, "email", "jane@e.org", "from"), (4, "email", "jane@e.org", "author"),
        (4, "email", "rob@e.org", "committer"), (5, "category", "src", "category"), (6, "category", "jane roe", "category"),
        (6, "person", "jane roe", "mentions"), (6, "org", "acme corp", "mentions"),
    }


def test_names_and_links(docs):
    votes = entities.name_votes(entities.occurrences(docs, SEEDS))
    links, extra = entities.linked(votes, ALIASES)
    known = {(r.kind, r.key): r.display for r in entities.entities(votes.unionByName(extra)).collect()}
    assert known["email", "jane@e.org"] == "Jane" or known["email", "jane@e.org"] == "J. Roe"
    assert known["email", "hid@e.org"] == "hid@e.org"
    assert known["person", "jane roe"] == "Jane Roe " and known["person", "jane q roe"] == "Jane Q. Roe"
    assert known["org", "acme inc"] == "Acme, Inc."
    assert {tuple(r) for r in links.collect()} == {  # equal normalised aliases: the last one counts
        ("email", "jane@e.org", "alias_of", "person", "jane q roe"),
        ("person", "jane q roe", "member_of", "org", "acme inc"),
    }


def test_most_frequent_spelling_and_first_among_equals(spark):
    schema = "kind string, key string, display string, votes long, at struct<source:string,path:string,n:int>"
    votes = spark.createDataFrame([
        ("email", "k", "A", 2, ("s", "z", 0)), ("email", "k", "B", 1, ("s", "a", 0)), ("email", "t", "late", 1, ("s", "b", 0)),
        ("email", "t", "early", 1, ("s", "a", 0)), ("org", "k", "First", 1, ("s", "a", 0)), ("org", "k", "Often", 9, ("s", "b", 0)),
    ], schema)
    assert {(r.kind, r.key): r.display for r in entities.entities(votes).collect()} == {
        ("email", "k"): "A", ("email", "t"): "early", ("org", "k"): "First",
    }


def test_find_prefers_kinds_in_order(spark):
    known = spark.createDataFrame([(k, "x", k) for k in ("category", "org", "person", "email")], "kind string, key string, display string")
    assert [r.kind for r in entities.find(known, "x").collect()] == ["email", "person", "org", "category"]
    assert [r.kind for r in entities.find(known, "x", "org").collect()] == ["org"]
    assert entities.find(known, "y").count() == 0


def test_self_links_and_newest_first(spark):
    links = spark.createDataFrame([("person", "p", "knows", "person", "p"), ("person", "q", "knows", "person", "p")],
                                  "a_kind string, a_key string, rel string, b_kind string, b_key string")
    known = spark.createDataFrame([("person", "p", "P"), ("person", "q", "Q")], "kind string, key string, display string")
    assert sorted((r.direction, r.key) for r in entities.directed_links(links, known, "person", "p").collect()) == [
        ("in", "p"), ("in", "q"), ("out", "p"),
    ]
    assert sorted(r.key for r in entities.neighbours(links, known, "person", "p").collect()) == ["p", "q"]
    edges = spark.createDataFrame([(i, "person", "p", "mentions") for i in range(4)], "doc_id long, kind string, key string, rel string")
    docs = spark.createDataFrame([(0, "s", "a", "t", "2020"), (1, "s", "b", "t", "2026"), (2, "s", "c", "t", "2023"), (3, "s", "d", "t", None)],
                                 "doc_id long, source string, path string, title string, doc_date string")
    newest = entities.newest_documents(edges, docs, "person", "p", 4).collect()
    assert [r.doc_date for r in newest] == ["2026", "2023", "2020", None]
    assert [r.doc_date for r in entities.newest_documents(edges, docs, "person", "p", 2).collect()] == ["2026", "2023"]


def test_address_field_shapes(spark):
    listed = spark.createDataFrame([(1, "s", "p", ["A <a@x>", "b@x, c@x"], [("D@x ", " Dee "), ("", "none")])],
                                   "doc_id long, source string, path string, to array<string>, cc array<struct<email:string,name:string>>")
    found = entities.mail_occurrences(listed, ("to", "cc")).collect()
    assert sorted((r.key, r.rel, r.display) for r in found) == [
        ("a@x", "to", "A"), ("b@x", "to", "b@x"), ("c@x", "to", "c@x"), ("d@x", "cc", "Dee"),
    ]


def test_name_files(tmp_path):
    assert names.load_seeds(None) == Seeds() and names.load_aliases(str(tmp_path / "none.toml")) == Aliases()
    (tmp_path / "s.toml").write_text('persons = ["A"]\norgs = ["B", "C"]\n')
    assert names.load_seeds(str(tmp_path / "s.toml")) == Seeds(("A",), ("B", "C"))
    (tmp_path / "a.toml").write_text('[alias_of]\n"x@y" = "A"\n[member_of]\n"A" = "B"\n')
    assert names.load_aliases(str(tmp_path / "a.toml")) == Aliases({"x@y": "A"}, {"A": "B"})


def test_mentions_by_automaton(spark):
    """Every name a text contains, once, in seed order; names inside and across one another, equal ones, blanks."""
    names = ["Anna", "anna b", "nn", " Anna ", "", "  ", "B", "Ünal", "zz"]
    seeds = entities.Seeds(persons=tuple(names), orgs=("ANNA", "nowhere"))
    texts = ["Anna Berg", "anna b", None, "", "ünal", "bob", "a" * 50_000 + "nna"]
    docs = spark.createDataFrame([(i, "s", f"p{i}", t) for i, t in enumerate(texts)], "doc_id long, source string, path string, title string")
    got = entities.mention_occurrences(docs, seeds).select("doc_id", "kind", "display", "at.n").collect()
    named = [("person", n) for n in names if n] + [("org", n) for n in seeds.orgs]
    want = [
        (i, kind, name, entities.MENTIONS_FROM + n) for i, t in enumerate(texts) for n, (kind, name) in enumerate(named)
        if name.strip().lower() in "\n".join(x for x in (t, f"p{i}") if x).lower()]
    assert sorted(map(tuple, got)) == sorted(want)
    assert entities.mention_occurrences(docs, entities.Seeds()).count() == 0
    with pytest.raises(ValueError, match="characters"):
        entities.mention_occurrences(docs, entities.Seeds(persons=("x" * (entities.SEED_CHARS + 1),)))
