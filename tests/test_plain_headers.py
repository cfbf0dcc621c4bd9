"""Headers that Spark parses by itself cost Python nothing."""

import pyarrow as pa
from pyspark.sql import functions as F

from gleanery.functions import addresses
from gleanery.operators import entities


def test_rows_without_a_header_are_not_parsed(monkeypatch):
    seen = []
    real = addresses.getaddresses
    monkeypatch.setattr(addresses, "getaddresses", lambda strings: seen.append(strings) or real(strings))
    kind = pa.list_(pa.string())
    parse = addresses.parse_headers.func
    for rows, want in (
        ([None, None], [[], []]), ([], []), ([[], None, [None]], [[], [], []]),
        ([None, ['"Desk, one" <d@e.org>', "f@g.org"], None], [[], [("d@e.org", "Desk, one"), ("f@g.org", None)], []]),
    ):
        got = parse(pa.array(rows, kind)).to_pylist()
        assert [[(a["address"], a["name"]) for a in r] for r in got] == want
    assert len(seen) <= 2


def test_long_headers_are_matched_in_one_loop(spark):
    """A header's length costs no stack, and one odd item anywhere makes it one for Python."""
    many = ", ".join(f"Desk {i} <d.{i}+x@e.org>" for i in range(50_000))
    rows = spark.createDataFrame([(1, many), (2, many + ","), (3, '"x" <y@z>, ' + many), (4, None), (5, "")], "i long, h string")
    got = {r.i: r.p for r in rows.select("i", addresses.is_plain(F.col("h")).alias("p")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: None, 5: False}


def test_occurrences_take_items_of_plain_headers_as_rows(spark):
    """Items are taken apart by compiled expressions: no lambda over a string header, and Python gets strings, not arrays."""
    docs = spark.createDataFrame(
        [(1, "s", "p", "A  B <A.b+t@E.org> , c@d.e", [("x@y.z", "")]), (2, "s", "q", '"R, J" <j@x>', []), (3, "s", "r", None, None)],
        "doc_id long, source string, path string, from string, to array<struct<email:string,name:string>>")
    found = entities.mail_occurrences(docs, ("from", "to"))
    assert {(r.doc_id, r.key, r.rel, r.display, r["at"].n) for r in found.collect()} == {
        (1, "a.b@e.org", "from", "A B", 0), (1, "c@d.e", "from", "c@d.e", 1), (1, "x@y.z", "to", "x@y.z", 2), (2, "j@x", "from", "R, J", 0)}
    plan = entities.mail_occurrences(docs.drop("to"), ("from",))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "parse_odd" in plan
