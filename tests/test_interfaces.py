"""The command line and the tools over one small corpus."""

import json

import pytest

from conftest import make_corpus
from gleanery import cli, config, tools
from gleanery.engine import Engine


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    return make_corpus(tmp_path_factory.mktemp("cli"))


@pytest.fixture(scope="module")
def run(spark, place):
    def go(command, *args):
        return cli.main([command, "--config", str(place / "gleanery.toml"), *args], spark)

    assert go("update", "--no-embed") == 0
    return go


def test_update_and_stats(run, capsys):
    assert run("update", "--no-embed", "--source", "files") == 0
    assert capsys.readouterr().out == "files: added=0 changed=0 deleted=0 unchanged=11 chunks=0\n"
    assert run("update", "--source", "nope") == 1
    assert "unknown source" in capsys.readouterr().err
    assert run("stats", "--json") == 0
    stats = json.loads(capsys.readouterr().out)
    assert stats["sources"]["mail"] == {"documents": 6, "chunks": 11, "embedded": 0} and stats["db_bytes"] > 0
    assert run("stats") == 0
    assert "repo: documents=5 chunks=5 embedded=0" in capsys.readouterr().out


def test_embedding_needs_a_key(run, capsys, monkeypatch):
    monkeypatch.delenv("VOYAGE_API_KEY", raising=False)
    assert run("embed", "--dry-run") == 0
    assert capsys.readouterr().out.splitlines()[-1].startswith("total: chunks=25 ")
    assert run("embed") == 1 and run("update") == 1
    assert "VOYAGE_API_KEY" in capsys.readouterr().err


def test_search(run, capsys):
    assert run("search", "lighthouse", "--mode", "lexical", "--json", "--limit", "2") == 0
    out = capsys.readouterr()
    hits = json.loads(out.out)
    assert len(hits) == 2 and out.err == ""
    assert set(hits[0]) == {"source", "path", "title", "date", "score", "excerpt", "chunk_seq", "content_indexed"}
    assert run("search", "lighthouse", "--rerank", "--source", "mail") == 0
    out = capsys.readouterr()
    assert "degrading to lexical" in out.err and "not yet implemented" in out.err
    assert out.out.startswith("1. [0.0164] mail/2024/3/7/aa01.eml  2024-03-07T09:41:20+00:00  Quote QX-2024-0417\n")


def test_doc_and_entity(run, capsys):
    assert run("doc", "mail", "2025/2/1/aa06.eml", "--json") == 0
    doc = json.loads(capsys.readouterr().out)
    assert doc["content"] is None and doc["meta"]["from"] == "nora.field@example.org" and doc["meta"]["cc"] is None
    assert run("doc", "files", "minutes/march.md") == 0
    assert "---\nfiles/minutes/march.md" in capsys.readouterr().out
    assert run("doc", "files", "gone") == 1
    assert run("entity", "nora field", "--json") == 0
    card = json.loads(capsys.readouterr().out)
    assert card["entity"] == {"kind": "person", "key": "nora field", "display": "Nora Field"}
    assert {(link["direction"], link["rel"]) for link in card["links"]} == {("out", "member_of"), ("in", "alias_of")}
    assert run("entity", "nora.field@example.org") == 0
    assert "-> alias_of person:nora field (Nora Field)" in capsys.readouterr().out
    assert run("entity", "nobody") == 1
    assert run("entity", "finance", "--kind", "org") == 1


def test_review_file(run, place, capsys):
    assert run("bootstrap-aliases", "--top", "5") == 0
    assert (place / "aliases-bootstrap.toml").read_text().count("documents,") == 5


def test_configuration_errors_exit_with_two(spark, tmp_path, capsys):
    assert cli.main(["stats", "--config", str(tmp_path / "none.toml")], spark) == 2
    with pytest.raises(SystemExit):
        cli.main(["unknown"], spark)


def test_tools(spark, run, place):
    tools.configure(None)
    with pytest.raises(RuntimeError):
        tools.search("x")
    tools.configure(Engine(spark, config.load(place / "gleanery.toml")))
    for mode in ("hybrid", "semantic", "lexical"):  # no vectors: all of them search words
        assert {h["source"] for h in tools.search("lighthouse", mode=mode)["hits"]} == {"files", "mail", "repo"}
    assert len(tools.search("lighthouse", sources=["mail"], since="2024-01-01", until="2025-01-01", limit=3)["hits"]) == 1
    doc = tools.get_document("files", "minutes/march.md", max_chars=12)
    assert (doc["content"], doc["truncated"], doc["meta"]) == ("files/minute", True, {})
    assert "error" in tools.get_document("files", "gone")
    card = tools.related_entities("nora.field@example.org", limit=2)
    assert card["entity"]["kind"] == "email" and len(card["documents"]) == 2
    assert card["links"] == [{"rel": "alias_of", "kind": "person", "key": "nora field", "display": "Nora Field"}]
    assert "error" in tools.related_entities("nobody", kind="org")
    assert [t.__name__ for t in tools.TOOLS] == ["search", "get_document", "related_entities"]
