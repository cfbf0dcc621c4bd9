"""Top lists from blocks against top lists from all postings."""

import random

import pytest
from pyspark.sql import functions as F

from gleanery import config
from gleanery.operators.entities import Aliases, Seeds
from gleanery.plans import index as index_module
from gleanery.plans import pruning, search
from gleanery.plans.index import CHUNK, Index
from gleanery.plans.update import merge_parts, update_source
from gleanery.tables import table_loader, table_probes


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    patch = pytest.MonkeyPatch()
    patch.setattr(index_module, "SPAN_BITS", 3)
    patch.setattr(index_module, "LONG_LIST", 40)
    rng = random.Random(6)
    made = Index(spark, str(tmp_path_factory.mktemp("pruned") / "index"))
    for name, first in (("a", 0), ("b", 300)):
        texts = [
            (f"{n}.txt", f"2024-{n % 12 + 1:02d}-01", " ".join(
                ["lamp"] * (rng.randrange(9) if n % 40 < 4 else rng.randrange(2)) + ["rope"] * rng.randrange(3)
                + ["filler"] * rng.randrange(5, 90) + ["zebra"] * (n % 97 == 0)))
            for n in range(first, first + 300)]
        rows = spark.createDataFrame(texts, "path string, doc_date string, text string")
        source = config.Source(name, "filetree", "/nowhere")
        update_source(made, source, Seeds(), Aliases(), probes=table_probes(rows, source), loader=table_loader(rows))
    yield made
    patch.undo()


@pytest.mark.parametrize("words", [["lamp"], ["lamp", "rope"], ["filler", "lamp"], ["zebra"], ["lamp", "zebra"], ["lamp", "nowher"]])
def test_same_rows(index, monkeypatch, words):
    monkeypatch.setattr(pruning, "FIRST_SPANS", 6)
    for keep in (None, (F.col("doc_date") >= "2024-06") & F.col("source").isin("b")):
        for limit in (5, 50):
            got = pruning.pruned_scores(index, words, keep, limit)
            assert (got is None) == (words == ["zebra"])
            with monkeypatch.context() as whole:
                whole.setattr(pruning, "pruned_scores", lambda *a: None)
                want = search.lexical_scores(index, [[w] for w in words], keep, limit)
            if got is not None:
                columns = [*CHUNK, "score"]
                assert got.select(*columns).collect() == want.select(*columns).collect()


def test_spans_are_left_out(index, monkeypatch):
    monkeypatch.setattr(pruning, "FIRST_SPANS", 6)
    asked = []
    real = pruning._scores
    monkeypatch.setattr(pruning, "_scores", lambda *a: asked.append(a[-1]) or real(*a))
    every = index.read("postings", F.col("term") == "lamp").select("batch", "span").distinct().count()
    pruning.pruned_scores(index, ["lamp"], None, 5)
    assert len(asked[0]) == 6 and len(asked[1]) < every / 2
    monkeypatch.setattr(pruning, "MOST_SPANS", 2)
    want = [round(r.score, 9) for r in pruning.pruned_scores(index, ["lamp"], None, 50).collect()]
    assert asked[-1] is None and want == sorted(want, reverse=True)


def test_merged_parts_have_blocks_too(index):
    merge_parts(index, Aliases(), full=True)
    assert {r.term for r in index.read("blocks").select("term").distinct().collect()} >= {"lamp", "filler", "rope"}
    assert [r.path for r in search.search(index, "lamp", mode="lexical").collect()]
