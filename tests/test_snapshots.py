"""Snapshots of an index: dying runs, several writers, merging, old readers, cleaning."""

import pytest
from pyspark.sql import functions as F

from gleanery import config
from gleanery.operators import entities
from gleanery.operators.entities import Aliases, Seeds
from gleanery.plans import embed
from gleanery.plans.index import FAN, TABLES, Index, SchemaVersionError
from gleanery.plans.search import search
from gleanery.plans.snapshots import ConflictError, Part
from gleanery.plans.update import merge_parts, update_source
from gleanery.tables import table_loader, table_probes

SEEDS, ALIASES = Seeds(persons=("Harbour",)), Aliases(member_of={"Harbour": "Port"})


def rows(spark, texts):
    return spark.createDataFrame(
        [(f"shelf{n % 3}/harbour{n}.txt", f"2024-01-{n % 28 + 1:02d}", t) for n, t in sorted(texts.items())],
        "path string, doc_date string, text string")


def update(index, name, texts):
    source, found = config.Source(name, "filetree", "/nowhere"), rows(index.spark, texts)
    return update_source(index, source, SEEDS, ALIASES, probes=table_probes(found, source), loader=table_loader(found))


def lamps(first, last, word="lamp"):
    return {n: f"the {word} number {n}. " * (n + 1) for n in range(first, last)}


def state(index):
    """All a reader can see, without the numbers of runs and rows."""
    index.refresh()
    listed = lambda name, *columns: sorted(map(tuple, index.live(name).select(*columns).collect()), key=repr)
    totals = index.totals()
    known = entities.entities(index.read("names"))
    return {
        "documents": listed("documents", "source", "path", "doc_date", "content_hash", "text"),
        "chunks": listed("chunks", "source", "path", "seq", "text", "words"),
        "postings": listed("postings", "term", "source", "seq", "dl", "tf", F.col("positions").cast("string")),
        "occurrences": listed("occurrences", "kind", "key", "rel", "display", "doc_date", "at.source", "at.path", "at.n"),
        "links": sorted(map(tuple, index.read("links").distinct().collect())),
        "entities": sorted(map(tuple, known.collect())),
        "totals": (totals.chunks, totals.words),
        "hits": [(h.source, h.path, round(h.score, 9), h.excerpt) for w in ("lamp", "candle number") for h in search(index, w, mode="lexical").collect()],
    }


def held_now(index):
    """The documents and totals of the published snapshot."""
    index.refresh()
    totals = index.totals()
    return sorted(map(tuple, index.live("documents").select("source", "path", "text").collect())), (totals.chunks, totals.words)


@pytest.fixture
def index(spark, tmp_path):
    return Index(spark, str(tmp_path / "index"))


def history(index):
    """Additions, changes and deletions in several runs; returns what the sources hold at the end."""
    a, b = lamps(0, 8), lamps(3, 6)
    update(index, "a", a)
    update(index, "b", b)
    a |= lamps(2, 4, "candle")
    del a[7]
    update(index, "a", a)
    del b[3]
    update(index, "b", b | lamps(20, 22))
    a |= lamps(30, 31, "candle")
    update(index, "a", a)
    return {"a": a, "b": b | lamps(20, 22)}


def rebuilt(spark, folder, held):
    fresh = Index(spark, str(folder))
    for name, texts in held.items():
        update(fresh, name, texts)
    return fresh


def test_merged_equals_rebuilt(spark, tmp_path, index):
    held = history(index)
    fresh = state(rebuilt(spark, tmp_path / "fresh", held))
    before = state(index)
    assert {k: v for k, v in before.items() if k != "entities"} == {k: v for k, v in fresh.items() if k != "entities"}
    old = Index(spark, index.root)
    assert len(merge_parts(index, ALIASES, full=True)) == 1
    assert state(index) == fresh
    assert len(index.snapshot.parts) == 1 and index.totals().retired == 0
    assert index.read("documents").count() == index.live("documents").count()  # dead rows are gone
    assert old.live("documents").count() == len(fresh["documents"])  # and the old snapshot still reads
    assert Index(spark, index.root, version=3).live("documents").where("source = 'b'").count() == 3
    assert merge_parts(index, ALIASES, full=True) == []

    # Identities outlive the merge: later updates find what they replace.
    held["a"] |= lamps(0, 2, "candle")
    assert update(index, "a", held["a"]).changed == 2
    again = rebuilt(spark, tmp_path / "again", held)
    assert held_now(index) == held_now(again)
    gone = index.clean(keep=1)
    assert gone and index.log.versions() == [index.snapshot.version]
    assert index.totals().chunks == index.live("chunks").count()
    assert not any(index.log.has_rows("documents", n) for n in gone)


def test_merging_by_size(index):
    for n in range(FAN):
        update(index, f"s{n}", lamps(n, n + 1))
    update(index, "large", lamps(0, 40))
    chosen = {p.chunks for p in index.mergeable()}
    assert chosen == {1}
    assert [set(p.layouts) for p in merge_parts(index, ALIASES)] == [{f"s{n}" for n in range(FAN)}]
    assert sorted(p.chunks for p in index.snapshot.parts) == [FAN, 40]
    assert index.mergeable() == []


def test_partial_merge_keeps_what_is_retired_elsewhere(spark, tmp_path, index):
    a, b = lamps(0, 3), lamps(0, 30)
    update(index, "b", b)
    update(index, "a", a)
    del b[4]
    update(index, "b", b)  # retires a row of the first part
    small = [p for p in index.snapshot.parts if p.chunks < 10]
    from gleanery.plans.update import write_names

    merged = index.merge(small, lambda found, part: write_names(index, found, part, ALIASES))
    assert merged.retired == 1 and len(index.snapshot.parts) == 2
    assert held_now(index) == held_now(rebuilt(spark, tmp_path / "fresh", {"a": a, "b": b}))


def test_a_run_that_dies_after_any_table_never_was(spark, tmp_path, index, monkeypatch):
    update(index, "a", lamps(0, 3))
    before = state(index)
    changed = {**lamps(1, 3), 1: "a candle", 9: "a lamp"}
    real = Index.append
    tables = [t for t in TABLES if t != "vectors"]
    for table in tables:
        def dying(self, name, *args, table=table, **options):
            out = real(self, name, *args, **options)
            if name == table:
                raise MemoryError("killed")
            return out

        with monkeypatch.context() as broken:
            broken.setattr(Index, "append", dying)
            with pytest.raises(MemoryError):
                update(index, "a", changed)
    assert state(Index(spark, index.root)) == before
    outcome = update(index, "a", changed)
    assert (outcome.added, outcome.changed, outcome.deleted) == (1, 1, 1)
    after = state(rebuilt(spark, tmp_path / "fresh", {"a": changed}))
    assert {k: v for k, v in state(index).items() if k != "entities"} == {k: v for k, v in after.items() if k != "entities"}
    assert len(index.log.reserved()) == 2 + len(tables)
    index.clean(unpublished_after=-1)
    assert sorted(index.log.reserved()) == sorted(index.snapshot.numbers())


def interleaved(index, monkeypatch, meanwhile):
    """``meanwhile`` runs when an update has written its documents."""
    real = Index.append

    def slow(self, name, *args, **options):
        out = real(self, name, *args, **options)
        if name == "documents" and self is index:
            monkeypatch.setattr(Index, "append", real)
            meanwhile()
        return out

    monkeypatch.setattr(Index, "append", slow)


def test_two_writers(spark, tmp_path, index, monkeypatch):
    other = Index(spark, index.root)
    update(index, "a", lamps(0, 2))
    interleaved(index, monkeypatch, lambda: update(other, "b", lamps(5, 7)))
    update(index, "a", lamps(1, 4))
    fresh = state(rebuilt(spark, tmp_path / "fresh", {"a": lamps(1, 4), "b": lamps(5, 7)}))
    now = state(index)
    assert all(now[k] == fresh[k] for k in ("documents", "totals", "hits"))

    interleaved(index, monkeypatch, lambda: update(other, "a", lamps(1, 6)))
    with pytest.raises(ConflictError):
        update(index, "a", lamps(1, 5))
    assert held_now(index) == held_now(other)
    assert update(index, "a", lamps(1, 5)).deleted == 1


def test_update_while_merging(spark, tmp_path, index, monkeypatch):
    other = Index(spark, index.root)
    update(index, "a", lamps(0, 4))
    update(index, "b", lamps(0, 2))
    interleaved(index, monkeypatch, lambda: update(other, "a", lamps(2, 5)))
    merge_parts(index, ALIASES, full=True)
    assert held_now(index) == held_now(rebuilt(spark, tmp_path / "fresh", {"a": lamps(2, 5), "b": lamps(0, 2)}))
    interleaved(index, monkeypatch, lambda: merge_parts(other, ALIASES, full=True))
    with pytest.raises(ConflictError):
        merge_parts(index, ALIASES, full=True)


def test_a_version_is_given_once(index):
    base = index.snapshot
    assert index.log.publish(type(base)(base.version + 1, base.schema, (Part(1),)))
    assert not index.log.publish(type(base)(base.version + 1, base.schema, (Part(2),)))
    assert index.log.load().numbers() == [1]
    numbers = [index.begin() for _ in range(3)]
    assert len(set(numbers)) == 3


def test_older_layouts_are_refused(spark, tmp_path):
    (tmp_path / "old" / "commits").mkdir(parents=True)
    with pytest.raises(SchemaVersionError):
        Index(spark, str(tmp_path / "old"))


def test_vectors_of_a_killed_run_are_adopted(spark, tmp_path, index, monkeypatch):
    update(index, "a", lamps(0, 6))

    class Client:
        def embed(self, texts, model, input_type):
            return type("R", (), {"embeddings": [[float(len(t))] for t in texts]})()


    class Models:
        models, embed_rules = {"prose": "p", "code": "c"}, {"a": ()}

    with monkeypatch.context() as broken:
        broken.setattr(Index, "publish", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            embed.drain(index, Models, Client)
    index.refresh()
    assert index.read("vectors").count() == 0
    assert embed.drain(index, Models, Client).embedded == 0  # all were there already
    assert index.read("vectors").count() == 6
    assert embed.drain(index, Models, Client).embedded == 0 and index.read("vectors").count() == 6


def test_newest_documents_of_an_entity_with_many(spark, tmp_path):
    from gleanery.engine import Engine

    (tmp_path / "gleanery.toml").write_text('db = "index"\n[[sources]]\nname = "a"\ntype = "filetree"\nroot = "."\n')
    engine = Engine(spark, config.load(tmp_path / "gleanery.toml"))
    update(engine.index, "a", lamps(0, 60))
    want = sorted(((f"2024-01-{n % 28 + 1:02d}", f"shelf{n % 3}/harbour{n}.txt") for n in range(60)), key=lambda r: r[1])
    want.sort(key=lambda r: r[0], reverse=True)
    for limit in (1, 20, 100):
        got = [(r.doc_date, r.path) for r in engine.entity_documents("person", "harbour", limit).collect()]
        assert got == want[:limit]
    plan = engine.entity_documents("person", "harbour", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" in plan and plan.count("Relation") == 1  # documents by id; occurrences were asked before
    assert {(r.direction, r.key) for r in engine.entity_links("org", "port").collect()} == {("in", "harbour")}
    assert {(r.direction, r.key) for r in engine.entity_links("person", "harbour").collect()} == {("out", "port")}
