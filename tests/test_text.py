"""Column helpers against plain Python on awkward inputs."""

import fnmatch
import random
import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from gleanery.functions import addresses, headers, markup
from gleanery.functions import text as tx
from gleanery.operators import changes
from gleanery.sources.globs import glob_regex, selected

AWKWARD = [
    "", " ", "\n", "\t a \x0b b\x0c\r\n c  d \x1c", "x" * 199, "x" * 200, "y " * 150, "é" * 250,
    "😀 é ", "a\n\n\nb", "a\n \t\nb\r\n\r\nc", "\x85x\x85", "a b c", "　ideographic　",
]
MAIL = [
    "Hello\n\nOn Mon, 1 Jan 2024, A B <a@b> wrote:\n> old\n> older",
    "Hello\n  \n   On Mon x wrote:   \nrest",
    "On a " + "z" * 190 + " wrote:\nq", "On a " + "z" * 230 + " wrote:\nq",
    "on x WROTE:\nq", "We wrote: not a tail\n> quote\n\n\n> more\n\n\nend", "   > indented\nkeep\n>last",
    "> only", "Monday On x wrote:\nkept", "text\r\nOn x\r\nwrote:\r\n> q", "a\n\n\n\n\nb", "line On x wrote:\nq", "",
]


def column(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, v string")
    return [r.o for r in rows.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_strip_squash_excerpt(spark):
    assert column(spark, AWKWARD, tx.strip) == [s.strip() for s in AWKWARD]
    assert column(spark, AWKWARD, tx.squash) == [" ".join(s.split()) for s in AWKWARD]
    flat = [" ".join(s.split()) for s in AWKWARD]
    assert column(spark, AWKWARD, tx.excerpt) == [s if len(s) <= 200 else s[:200].rstrip() + " ..." for s in flat]


def by_hand(body):
    """Quoted-history rules spelled out line by line."""
    starts = [m.start() for m in re.finditer(r"^\s*On\s.{0,200}?wrote:\s*$", body, re.I | re.M)]
    head = body[:starts[0]] if starts else body
    lines = [line for line in head.split("\n") if line.lstrip()[:1] != ">"]
    return re.sub("\n\n\n+", "\n\n", "\n".join(lines)).strip()


def test_quoted_history(spark):
    assert column(spark, MAIL, tx.strip_quoted_history) == [by_hand(m) for m in MAIL]


def test_quoted_history_random(spark):
    rng = random.Random(3)
    parts = ["On ", "on ", "wrote:", "WROTE: ", ">", "\n", "\n", "\r", "\t", " ", "a", "b" * 201, "\n> ", "\n\n"]
    bodies = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(5000)]
    assert column(spark, bodies, tx.strip_quoted_history) == [by_hand(b) for b in bodies]


PATHS = ["a.txt", "A.TXT", "x/.bashrc", "x/y.tar.gz", "noext", "dir.d/file", "trailing.", "a/b.PY", "s.pdf", "s.xlsx",
         "p.odt", "..py", "c.JS", "commit/0123.py", "m.rs", "a b.md"]


def test_suffix_handling_and_routing(spark):
    assert column(spark, PATHS, tx.suffix) == [
        "" if p == "trailing." else PurePosixPath(p).suffix.lower() for p in PATHS
    ]
    handling = dict(zip(PATHS, column(spark, PATHS, tx.handling)))
    assert handling["a.txt"] == handling["a/b.PY"] == handling["c.JS"] == "decode"
    assert handling["s.pdf"] == handling["p.odt"] == "convert"
    assert handling["s.xlsx"] == handling["noext"] == handling["x/.bashrc"] == "metadata"
    kind = dict(zip(PATHS, column(spark, PATHS, tx.model_kind)))
    assert kind["a/b.PY"] == kind["m.rs"] == "code"
    assert kind["c.JS"] == kind["commit/0123.py"] == kind["a.txt"] == "prose"
    assert column(spark, PATHS, tx.basename) == [PurePosixPath(p).name for p in PATHS]


def test_bytes(spark):
    raws = [b"plain", "é".encode(), b"caf\xe9", b"\xff\xfe", b"", b"a\x00", b"z" * 8192 + b"\x00", b"z" * 8191 + b"\x00"]
    rows = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i long, raw binary")
    out = rows.select("i", tx.decode_bytes(F.col("raw")).alias("t"), tx.looks_binary(F.col("raw")).alias("b")).orderBy("i").collect()

    def decoded(raw):
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("latin-1")

    assert [r.t for r in out] == [decoded(r) for r in raws]
    assert [r.b for r in out] == [False] * 5 + [True, False, True]


PAGES = [
    "<p>a</p><p>b</p>", "a<br/>b<br>c<hr>d", "<script>x<p>y</p></script>z", "<style>s</style>t", "&lt;tag&gt; &amp; &eacute; &#65; &nope",
    "<div>  many   spaces\t\there </div>\n\n\n\n<div>next</div>", "<ul><li>1<li>2</ul>", "plain text", "", "<!-- gone -->kept",
    "<p>unclosed <b>bold", "<script>never closed", "</script>stray", "<h1>T</h1>text<table><tr><td>c1</td><td>c2</td></tr></table>",
    "x<p>  </p>y", "<P>UPPER</P><SCRIPT>no</SCRIPT>", "a < b and c > d", "<p/>self", "<!DOCTYPE html><title>Title</title><body>B",
]


def test_html(spark):
    expected = [
        "a\n\nb", "a\nb\nc\nd", "z", "t", "<tag> & é A &nope", "many spaces here\n\nnext", "1\n2", "plain text", "", "kept",
        "unclosed bold", "", "stray", "T\ntext\n\nc1c2", "x\n\ny", "UPPER", "a < b and c > d", "self", "TitleB",
    ]
    assert column(spark, PAGES, markup.html_to_text) == expected


def test_header_lines(spark):
    rows = spark.createDataFrame(
        [(1, "Subject", "a@x", "2024-03-07T10:00:00+00:00"), (2, None, None, None), (3, "", "b@x", "")],
        "i long, subject string, sender string, day string",
    )
    line = headers.mail_header(F.col("subject"), F.col("sender"), F.col("day")).alias("o")
    assert [r.o for r in rows.orderBy("i").select(line).collect()] == [
        "Subject — a@x, 2024-03-07", "(no subject) — None, ", "(no subject) — b@x, ",
    ]
    meta = "struct<from:string,to:string,cc:string,bcc:string,reply_to:string,labels:array<string>>"
    full = spark.createDataFrame([
        (1, ("f", "t", "c", "b", "r", ["A", "B"]), "S", "D"), (2, ("f", None, "", None, None, []), None, None),
        (3, (None, None, None, None, None, None), None, None),
    ], f"i long, meta {meta}, s string, d string")
    block = headers.mail_block(F.col("meta"), F.col("s"), F.col("d")).alias("o")
    assert [r.o for r in full.orderBy("i").select(block).collect()] == [
        "From: f\nTo: t\nCc: c\nBcc: b\nReply-To: r\nSubject: S\nDate: D\nLabels: A, B", "From: f", None,
    ]
    sha = F.lit("0123456789")
    commit = rows.orderBy("i").select(headers.commit_header(F.lit("repo"), sha, F.lit(None), F.col("day")).alias("o")).first().o
    assert commit == "repo 0123456  2024-03-07"


def test_keys(spark):
    raw = [" Jane.Roe+billing@Example.COM ", "not-an-address", "a+b", "x+y+z@h", "a@b+c@d", "Q@W"]
    assert column(spark, raw, addresses.email_key) == [
        "jane.roe@example.com", "not-an-address", "a+b", "x@h", "a@b+c@d", "q@w",
    ]
    names = ["  Acme,  Inc.  ", "O'Brien-Smith", "Zoë Straße", "a_b", "1½ & Co", ""]
    assert column(spark, names, addresses.slug) == ["acme inc", "o brien smith", "zoë straße", "a_b", "1½ co", ""]
    assert column(spark, ["a/b", "top.txt", "/x", " c /y"], addresses.category) == ["a", None, None, "c"]


@pytest.mark.parametrize("glob", ["*.md", "finance/**", "a?c", "[ab]*", "x.y", "*"])
def test_globs_match_as_shells_do(spark, glob):
    paths = ["a.md", "finance/a/b.md", "finance", "abc", "a\nc", "b/c", "xzy", "x.y", "finance/"]
    assert column(spark, paths, lambda c: c.rlike(glob_regex(glob))) == [fnmatch.fnmatchcase(p, glob) for p in paths]


def test_selection(spark):
    def keep(include, exclude):
        return column(spark, ["a/b.md", "a/b.txt", "c.md"], lambda c: selected(c, include, exclude))

    assert keep([], []) == [True, True, True]
    assert keep(["*.md"], []) == [True, False, True]
    assert keep(["*.md", "*.txt"], ["a/*"]) == [False, False, True]


def test_diff(spark):
    probes = spark.createDataFrame(
        [("s", "same", "1:1", None), ("s", "touched", "2:1", None), ("s", "new", "1:1", None),
         ("s", "blob", None, "aa"), ("s", "blob2", None, "bb"), ("s", "odd", None, None)],
        "source string, path string, stat_sig string, git_sha string",
    )
    stored = spark.createDataFrame(
        [("s", "same", "1:1", "h"), ("s", "touched", "1:1", "h"), ("s", "gone", "1:1", "h"),
         ("s", "blob", None, "aa"), ("s", "blob2", None, "aa"), ("s", "odd", None, None)],
        "source string, path string, stat_sig string, content_hash string",
    )
    found = {r.path: r.change for r in changes.diff(probes, stored).collect()}
    assert found == {"same": "unchanged", "touched": "changed", "new": "added", "gone": "deleted",
                     "blob": "unchanged", "blob2": "changed", "odd": "changed"}
    forced = {r.path: r.change for r in changes.diff(probes, stored, force=True).collect()}
    assert forced["same"] == forced["blob"] == "changed" and forced["gone"] == "deleted"
    tally = changes.counts(changes.diff(probes, stored)).first()
    assert (tally.added, tally.changed, tally.deleted, tally.unchanged) == (1, 3, 1, 2)


def test_declared_charsets(spark):
    euro = "Prix : 12,50 € — été"
    cases = [
        (euro.encode(), "iso-8859-15", euro), ("12 €".encode("iso-8859-15"), "ISO-8859-15", "12 €"), ("é".encode("cp1252"), None, "é"),
        ("caf\xe9".encode("latin-1"), "not-a-charset", "café"), (b"\xe9\xff", "ascii", "éÿ"), (b"\xe9", "rot13", "é"), (b"\xe9", "hex", "é"),
        ("日本".encode("shift_jis"), "shift_jis", "日本"), (b"", "latin-1", ""), (None, "latin-1", None),
    ]
    rows = spark.createDataFrame([(i, bytearray(raw) if raw is not None else None, c) for i, (raw, c, _) in enumerate(cases)], "i int, raw binary, c string")
    got = rows.select("i", tx.decode_declared(F.col("raw"), F.col("c")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [want for *_, want in cases]
