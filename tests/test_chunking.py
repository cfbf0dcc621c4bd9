"""Chunk shapes worked out by hand, and packing against a naive rebuild."""

import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import chunking


def chunks(spark, text, rule, header="H"):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    made = chunking.explode_chunks(rule(docs), F.lit(header))
    rows = sorted((r.seq, r.text) for r in made.collect())
    assert [n for n, _ in rows] == list(range(len(rows)))
    return [t for _, t in rows]


def prose(**limits):
    return lambda docs: chunking.chunk_prose(docs, F.col("text"), **limits)


def csv(**limits):
    return lambda docs: chunking.chunk_csv(docs, F.col("text"), **limits)


def code(**limits):
    return lambda docs: chunking.chunk_code(docs, F.col("text"), **limits)


def test_short_text_is_one_chunk(spark):
    assert chunks(spark, "  one\n\ntwo  ", prose()) == ["H\n\none\n\ntwo"]
    assert chunks(spark, " \n\n ", prose()) == [] == chunks(spark, "", prose()) == chunks(spark, None, prose())


def test_overlap_repeats_last_paragraph(spark):
    paras = [f"paragraph {i} " + "w" * 30 for i in range(8)]
    made = chunks(spark, "\n\n".join(paras), prose(target_tokens=30, overlap_tokens=10))
    assert made[0] == "H\n\n" + "\n\n".join(paras[:2])
    assert made[1] == "H\n\n" + "\n\n".join(paras[1:3])
    assert made[-1].endswith(paras[-1])


def test_oversize_paragraph_is_cut_without_overlap(spark):
    made = chunks(spark, "a\n\n" + "😀" * 250 + "\n\nz", prose(target_tokens=25, overlap_tokens=10))
    assert made == ["H\n\na"] + ["H\n\n" + "😀" * n for n in (100, 100, 50)] + ["H\n\nz"]


def test_markdown_sections_stay_apart(spark):
    text = "before\n\n# One\n\nfirst\n\n## Two\nsecond\n\n#notheading\n\n### \n\n####### seven"
    made = chunks(spark, text, prose(markdown=True))
    assert made == ["H\n\nbefore", "H\n\n# One\n\nfirst", "H\n\n## Two\nsecond\n\n#notheading", "H\n\n###\n\n####### seven"]


def test_csv(spark):
    rows = [f"{i},name {i}" for i in range(50)]
    made = chunks(spark, "id,name\n" + "\n".join(rows) + "\n", csv(target_tokens=20, overlap_tokens=0))
    assert all(m.startswith("H\n\nid,name\n") for m in made) and len(made) > 1
    assert [r for m in made for r in m.split("\n")[3:]] == rows
    assert chunks(spark, "id,name\n", csv()) == ["H\n\nid,name"]
    assert chunks(spark, "\n\n", csv()) == [] == chunks(spark, "", csv())
    assert chunks(spark, "a,b\n\n1,2\n\n", csv()) == ["H\n\na,b\n1,2"]


def test_code(spark):
    text = "import os\n\ndef f():\n    return 1\n\ndef g():\n    return 2\n"
    assert chunks(spark, text, code(target_tokens=7)) == [
        "H\n\nimport os\n", "H\n\ndef f():\n    return 1\n", "H\n\ndef g():\n    return 2",
    ]
    assert chunks(spark, "\n \n", code()) == []
    big = "def f():\n    a = 1\n\n    b = 2\n"
    assert chunks(spark, big, code(target_tokens=4)) == ["H\n\ndef f():\n    a =", "H\n\n 1", "H\n\nb = 2"]


def test_whole(spark):
    whole = lambda docs: chunking.chunk_whole(docs, F.col("text"))
    assert chunks(spark, " body\n\n" + "x" * 9000 + " ", whole) == ["H\n\nbody\n\n" + "x" * 9000]
    assert chunks(spark, "  ", whole) == []


def test_layouts_together(spark):
    docs = spark.createDataFrame(
        [(1, "mail", None, "L"), (2, "mail", "body", "L"), (3, "prose", None, None), (4, "csv", "h\n1", None),
         (5, "markdown", "# A\n\nx\n\n# B", None), (6, "code", "x = 1", None), (7, "whole", "w", None), (8, "code", "  ", None)],
        "doc_id long, layout string, text string, lead string",
    )
    made = chunking.chunk_by_layout(docs, F.concat(F.lit("h"), "doc_id"), F.col("lead"))
    found = sorted((r.doc_id, r.seq, r.text) for r in made.collect())
    assert found == [
        (1, 0, "h1\n\nL"), (2, 0, "h2\n\nL"), (2, 1, "h2\n\nbody"), (4, 0, "h4\n\nh\n1"),
        (5, 0, "h5\n\n# A\n\nx"), (5, 1, "h5\n\n# B"), (6, 0, "h6\n\nx = 1"), (7, 0, "h7\n\nw"),
    ]


def naive(units, target, overlap, joiner):
    """Rebuild runs of unit numbers by trying every extension on real strings."""
    runs, run = [], []

    def text(numbers):
        return joiner.join("x" * units[n] for n in numbers)

    for n, size in enumerate(units):
        if run and len(text(run + [n])) > target:
            runs.append(run)
            tail = []
            if overlap:
                fits = [run[k:] for k in range(len(run)) if len(text(run[k:])) <= overlap]
                tail = fits[0] if fits else run[-1:]
            run = tail
        run = run + [n]
    return runs + [run] if run else runs


@pytest.mark.parametrize("overlap", [0, 7, 20])
def test_packing_matches_naive_rebuild(overlap):
    rng = random.Random(overlap)
    for _ in range(300):
        units = [rng.randint(1, 40) for _ in range(rng.randint(0, 25))]
        for joiner in ("\n", "\n\n"):
            packed = chunking.pack(units, 40, overlap, len(joiner))
            assert [list(range(a, a + n)) for a, n in packed] == naive(units, 40, overlap, joiner)


def test_reconstruct(spark):
    rows = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "doc_id long, seq int, text string")
    assert {r.doc_id: r.content for r in chunking.reconstruct(rows).collect()} == {1: "a\n\nb", 2: "c"}
