"""The index end to end over small sources: first run, no-op, change, delete, relayout, failure."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import FILES, label_db, make_corpus, write_tree
from gleanery import config
from gleanery.engine import Engine, NotFound
from gleanery.operators.entities import Aliases, Seeds
from gleanery.plans import index as index_module
from gleanery.plans.index import Index, SchemaVersionError
from gleanery.plans.update import Outcome, update_source
from gleanery.sources import discovery, loading
from gleanery.sources.conversion import convert


@pytest.fixture(scope="module")
def engine(spark, corpus):
    made = Engine(spark, config.load(corpus / "gleanery.toml"))
    made.first = made.update()
    return made


def hits(engine, query, **options):
    return [r.asDict() for r in engine.search(query, mode="lexical", **options).collect()]


def test_first_run(engine):
    assert engine.first == {
        "files": Outcome(added=11, chunks=9), "mail": Outcome(added=6, chunks=11), "repo": Outcome(added=5, chunks=5),
    }
    assert engine.update() == {
        "files": Outcome(unchanged=11), "mail": Outcome(unchanged=6), "repo": Outcome(unchanged=5),
    }
    totals = engine.index.totals()
    live = engine.index.live("chunks").agg(F.count("seq"), F.sum("words")).first()
    assert (totals.chunks, totals.words, totals.retired) == (*live, 0)
    with pytest.raises(ValueError, match="unknown source"):
        engine.update(["nope"])


def test_stored_documents(engine):
    rows = {(r.source, r.path): r for r in engine.index.live("documents").collect()}
    mail = rows["mail", "2024/3/7/aa01.eml"]
    assert (mail.title, mail.doc_date) == ("Quote QX-2024-0417", "2024-03-07T09:41:20+00:00")
    assert mail.text == "The quote QX-2024-0417 covers invoicing for the lighthouse."
    assert mail.meta.labels == ["INBOX", "Quotes"]
    assert rows["mail", "2024/3/7/aa02.eml"].text == "Plain wins over markup."
    assert rows["mail", "2024/11/2/aa03.eml"].text == "Fish & chips\n\ncafé"
    sheet = rows["mail", "2025/1/6/aa04.eml"]
    assert sheet.meta.attachments == ["figures.xlsx"] and sheet.doc_date == "2025-01-06T00:00:00+00:00"
    assert (sheet.meta.bcc, sheet.meta.reply_to) == ("hidden@lund.example", "desk@example.org")
    assert rows["mail", "2023/6/9/aa05.eml"].title == "Fee of £40" and "£40" in rows["mail", "2023/6/9/aa05.eml"].text
    empty = rows["mail", "2025/2/1/aa06.eml"]
    assert empty.text is None and not empty.content_indexed
    assert rows["files", "latin.txt"].text == "café lighthouse"
    assert rows["files", "empty.txt"].text == "" and rows["files", "empty.txt"].content_indexed
    assert not rows["files", "blob.txt"].content_indexed and not rows["files", "finance/return.pdf"].content_indexed
    assert rows["files", "minutes/notice.html"].text == "Annual notice\n\nTea & cake"
    commit = next(r for (s, p), r in rows.items() if s == "repo" and r.title == "Add billing script")
    assert commit.text == "Add billing script\n\nIt prints the lighthouse bill." and commit.bytes == len(commit.text)
    assert commit.meta.files == ["scripts/bill.py"] and commit.doc_date == "2024-04-02T08:00:00+00:00"
    assert json.loads(commit.meta_json) == {
        "author_name": "Nora Field", "author_email": "Nora.Field@example.org", "files": ["scripts/bill.py"],
    }
    assert rows["repo", "docs/prices.md"].doc_date is None


def test_search(engine):
    assert hits(engine, "invoice")[0]["path"] in ("finance/summary.txt", "2024/3/7/aa01.eml")  # stemmed
    assert {h["source"] for h in hits(engine, "lighthouse")} == {"files", "mail", "repo"}
    assert [h["path"] for h in hits(engine, "lighthouse", sources=["mail"])] == ["2024/3/7/aa01.eml"]
    assert [h["path"] for h in hits(engine, "QX-2024-0417")] == ["2024/3/7/aa01.eml"]  # one hit per document
    assert [h["path"] for h in hits(engine, "sent", sources=["mail"])] == ["2024/3/7/aa02.eml"]  # a label
    assert hits(engine, "lamp", since="2024-04-01")  # undated documents drop out once a bound is given
    assert all(h["date"] for h in hits(engine, "lamp", since="2024-04-01"))
    assert not hits(engine, "QX", until="2024-03-07")  # text order: the day itself is before its own times
    assert hits(engine, "QX", until="2024-03-08")
    assert len(hits(engine, "nora", limit=2)) == 2
    assert hits(engine, "----") == hits(engine, "") == hits(engine, "zebra") == []
    assert engine.search("lighthouse", mode="semantic").count() == 0
    assert engine.search("lighthouse").count() == len(hits(engine, "lighthouse"))
    with pytest.raises(ValueError):
        engine.search("x", mode="fuzzy")


def test_document(engine):
    doc = engine.document("files", "minutes/march.md").first()
    header = "files/minutes/march.md\n\n"
    assert doc.content == f"{header}# March\n\nBoard met about Acme Corp.\n\n{header}## Actions\n\nBuy rope."
    assert engine.document("mail", "2025/2/1/aa06.eml").first().content is None
    assert engine.document("files", "empty.txt").first().content == ""
    cut = engine.clipped_document("files", "minutes/march.md", 10).first()
    assert cut.content == doc.content[:10] and cut.truncated
    with pytest.raises(NotFound):
        engine.document("files", "nothing")


def test_entities(engine):
    assert [tuple(r) for r in engine.entity("nora.field@example.org").collect()] == [
        ("email", "nora.field@example.org", "Nora Field")
    ]
    links = {tuple(r) for r in engine.entity_links("person", "nora field").collect()}
    assert links == {
        ("out", "member_of", "org", "harbour trust", "Harbour Trust"),
        ("in", "alias_of", "email", "nora.field@example.org", "Nora Field"),
    }
    assert engine.entity_neighbours("org", "harbour trust").first().key == "nora field"
    newest = [r.doc_date for r in engine.entity_documents("email", "nora.field@example.org", 3).collect()]
    assert newest == sorted(newest, reverse=True) and len(newest) == 3
    rels = {r.rel for r in engine.entity_documents("email", "nora.field@example.org", 50).collect()}
    assert rels == {"from", "to", "author"}
    assert engine.entity("hidden@lund.example").first() and engine.entity("desk@example.org").first()
    mentioned = {r.path for r in engine.entity_documents("org", "quote").collect()}
    assert mentioned == {"2024/3/7/aa01.eml", "2024/3/7/aa02.eml"}
    assert {r.key for r in engine.index.read("names").where("kind = 'category'").collect()} == {
        "finance", "minutes", "docs", "scripts",
    }
    assert engine.entity("nobody").count() == 0


def test_stats_and_review(engine, tmp_path):
    stats = {r.source: (r.documents, r.chunks, r.embedded) for r in engine.stats().collect()}
    assert stats == {"files": (11, 9, 0), "mail": (6, 11, 0), "repo": (5, 5, 0)}
    review = {r.key: (r.n, r.tags) for r in engine.alias_review().collect()}
    assert review["nora.field@example.org"] == (6, "correspondent+git author")
    assert "hidden@lund.example" not in review
    engine.write_alias_review(str(tmp_path / "review.toml"), 1)
    import tomllib

    assert list(tomllib.loads((tmp_path / "review.toml").read_text())["alias_of"]) == ["nora.field@example.org"]


def test_changes_deletes_and_rollback(spark, tmp_path):
    root = make_corpus(tmp_path)
    engine = Engine(spark, config.load(root / "gleanery.toml"))
    engine.update(["files"])
    before = {h["path"]: h["score"] for h in hits(engine, "lighthouse")}
    assert set(before) == {"finance/summary.txt", "latin.txt"}
    (root / "files/latin.txt").write_text("now about a windmill")
    os.utime(root / "files/latin.txt", ns=(1, 10**18))
    (root / "files/finance/ledger.csv").unlink()
    write_tree(root / "files", {"new/lamp.txt": b"a new lighthouse"})
    assert engine.update(["files"])["files"] == Outcome(added=1, changed=1, deleted=1, unchanged=9, chunks=2)
    assert {h["path"] for h in hits(engine, "lighthouse")} == {"finance/summary.txt", "new/lamp.txt"}
    assert [h["path"] for h in hits(engine, "windmill")] == ["latin.txt"]
    assert hits(engine, "rope") and all(h["path"] != "finance/ledger.csv" for h in hits(engine, "rope"))
    totals = engine.index.totals()
    live = engine.index.live("chunks").agg(F.count("seq"), F.sum("words")).first()
    assert (totals.chunks, totals.words) == tuple(live)
    with pytest.raises(NotFound):
        engine.document("files", "finance/ledger.csv")

    # A run that dies before its commit changes nothing and its leftovers do not matter.
    def broken(probes, source, tasks):
        return loading.load(probes, source, tasks).withColumn("title", F.raise_error(F.lit("lost executor")))

    (root / "files/new/lamp.txt").write_text("third version")
    with pytest.raises(Exception, match="lost executor"):
        update_source(engine.index, engine.config.source("files"), Seeds(), Aliases(), loader=broken)
    again = Engine(spark, engine.config)
    assert {h["path"] for h in hits(again, "lighthouse")} == {"finance/summary.txt", "new/lamp.txt"}
    assert again.update(["files"])["files"] == Outcome(changed=1, unchanged=10, chunks=1)
    assert {h["path"] for h in hits(again, "lighthouse")} == {"finance/summary.txt"}


def test_new_layout_reloads_everything(spark, tmp_path, monkeypatch):
    root = make_corpus(tmp_path)
    engine = Engine(spark, config.load(root / "gleanery.toml"))
    engine.update(["repo"])
    from gleanery.plans import update

    for module in (index_module, update):
        monkeypatch.setattr(module, "LAYOUT_VERSION", "next")
    assert engine.update(["repo"])["repo"] == Outcome(changed=5, chunks=5)
    assert engine.update(["repo"])["repo"] == Outcome(unchanged=5)
    assert engine.stats().where("source = 'repo'").first().chunks == 5
    monkeypatch.setattr(index_module, "SCHEMA_VERSION", "other")
    with pytest.raises(SchemaVersionError):
        Index(spark, engine.config.db)


@pytest.mark.parametrize("joined", [True, False])
def test_label_databases(spark, tmp_path, joined):
    label_db(tmp_path / "msg-db.sqlite", joined)
    found = {r.stem: r.labels for r in loading.mail_labels(spark, str(tmp_path)).collect()}
    assert found == ({"aa01": ["INBOX", "Quotes"], "aa02": ["Sent"]} if joined else {"aa01": ["INBOX", "Quotes"]})


def test_unreadable_labels(spark, tmp_path):
    assert loading.mail_labels(spark, str(tmp_path)).count() == 0
    (tmp_path / "msg-db.sqlite").write_bytes(b"not a database at all, just bytes" * 50)
    assert loading.mail_labels(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("splits", [1, 3, 256])
def test_discovery_is_complete_however_it_is_split(spark, tmp_path, splits):
    files = {f"d{i}/e{j}/f{k}.txt": b"x" for i in range(3) for j in range(3) for k in range(2)}
    root = write_tree(tmp_path / "tree", {**FILES, **files})
    spark.dataSource.register(discovery.FileTree)
    found = spark.read.format("file_tree").options(root=str(root), splits=splits).load().collect()
    expected = {p for p in {**FILES, **files} if p not in (".git/config", "msg-db.sqlite")}
    assert sorted(r.path for r in found) == sorted(expected)
    shared = spark.read.format("file_tree").options(root=str(root), splits=splits, per_share=1).load().collect()
    assert sorted(r.path for r in shared) == sorted(expected)
    stat = (root / "d0/e0/f0.txt").stat()
    assert {r.stat_sig for r in found if r.path == "d0/e0/f0.txt"} == {f"{stat.st_mtime_ns}:{stat.st_size}"}


def test_globs_and_commits(spark, corpus):
    source = config.Source("repo", "gitrepo", str(corpus / "repo"), include=("*.md",))
    paths = [r.path for r in discovery.probes(spark, source).collect()]
    assert sorted(p for p in paths if not p.startswith("commit/")) == ["docs/prices.md"]
    assert len(paths) == 4  # globs do not apply to commits
    files = config.Source("f", "filetree", str(corpus / "files"), exclude=("finance/*", ".*", "_*"))
    assert all(not r.path.startswith(("finance", ".", "_")) for r in discovery.probes(spark, files).collect())


def test_path_dates():
    assert loading.path_date("2024/3/7/a.eml") == "2024-03-07T00:00:00+00:00"
    assert loading.path_date("2024/13/7/a.eml") is None and loading.path_date("x/y/z/a.eml") is None
    assert loading.path_date("2024/3/a.eml") is None


def test_conversion_never_raises(tmp_path, monkeypatch):
    for name in ("a.pdf", "a.doc", "a.docx", "a.rtf", "a.odt", "a.txt"):
        (tmp_path / name).write_bytes(b"not a real document")
        assert convert(str(tmp_path / name)) is None
    tool = tmp_path / "bin" / "pdftotext"
    write_tree(tmp_path, {"bin/pdftotext": b"#!/bin/sh\nprintf '  page text\\n'\n"})
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path / 'bin'}:{os.environ['PATH']}")
    assert convert(str(tmp_path / "a.pdf")) == "page text"
    tool.write_bytes(b"#!/bin/sh\nprintf 'caf\\351'\n")
    assert convert(str(tmp_path / "a.pdf")) == "café"
    tool.write_bytes(b"#!/bin/sh\nexit 3\n")
    assert convert(str(tmp_path / "a.pdf")) is None
    assert shutil.which("pdftotext") == str(tool)


def test_a_dead_run_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    """A run dies after its documents were written; an empty source is updated next, then the first one again."""
    from gleanery.plans import update as update_module
    from gleanery.tables import table_loader, table_probes

    documents = spark.createDataFrame(
        [(f"{i}.txt", "2024-01-01", f"the lamp number {i}") for i in range(3)], "path string, doc_date string, text string")
    index = Index(spark, str(tmp_path / "index"))

    def update(name, rows):
        source = config.Source(name, "filetree", str(tmp_path))
        return update_source(index, source, Seeds(), Aliases(), probes=table_probes(rows, source), loader=table_loader(rows))

    with monkeypatch.context() as broken:
        broken.setattr(update_module, "write_entities", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            update("a", documents)
    assert update("b", documents.limit(0)) == Outcome()
    assert index.live("documents").count() == 0
    assert update("a", documents).added == 3
    assert index.live("documents").count() == index.totals().chunks == 3
    from gleanery.plans.search import search

    assert search(index, "lamp", mode="lexical").count() == 3
