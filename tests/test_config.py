"""The configuration file: defaults, paths, and everything that must be refused."""

import tomllib

import pytest

from gleanery import config

GOOD = """
db = "data/index"
[[sources]]
name = "a"
type = "filetree"
root = "files"
convert = [".PDF", "docx"]
include = ["*.md"]
[[sources]]
name = "b"
type = "gitrepo"
root = "/abs/repo"
branch = "dev"
embed = false
embed_exclude = ["x/*"]
[models]
code = "own-code"
[entities]
seeds = "seeds.toml"
"""


def test_good(tmp_path):
    cfg = config.parse(tomllib.loads(GOOD), tmp_path)
    a, b = cfg.sources
    assert cfg.db == str(tmp_path / "data/index") and a.root == str(tmp_path / "files") and b.root == "/abs/repo"
    assert a.convert == ("pdf", "docx") and a.include == ("*.md",) and a.embed and a.branch is None
    assert b.branch == "dev" and not b.embed
    assert cfg.models == {"prose": config.PROSE_MODEL, "code": "own-code"}
    assert cfg.seeds == str(tmp_path / "seeds.toml") and cfg.aliases is None
    assert cfg.embed_rules == {"a": ()}
    assert cfg.source("b") is b
    with pytest.raises(KeyError):
        cfg.source("c")
    assert config.parse({**tomllib.loads(GOOD), "db": "s3a://bucket/index"}, tmp_path).db == "s3a://bucket/index"


SOURCE = {"name": "a", "type": "filetree", "root": "r"}


@pytest.mark.parametrize("data", [
    {}, {"db": "x"}, {"db": "x", "sources": []}, {"db": 1, "sources": [SOURCE]}, {"db": "x", "sources": [SOURCE], "more": 1},
    {"db": "x", "sources": [SOURCE, SOURCE]}, {"db": "x", "sources": ["a"]}, {"db": "x", "sources": {"name": "a"}},
    {"db": "x", "sources": [SOURCE], "models": {"other": "m"}}, {"db": "x", "sources": [SOURCE], "entities": {"seeds": 1}},
    *[{"db": "x", "sources": [{**SOURCE, **wrong}]} for wrong in (
        {"name": ""}, {"type": "zip"}, {"branch": "main"}, {"convert": ["."]}, {"include": "*.md"}, {"include": [1]},
        {"embed": "yes"}, {"colour": "red"}, {"root": "s3a://bucket/docs"}, {"root": "file:///docs"})],
    *[{"db": "x", "sources": [{k: v for k, v in SOURCE.items() if k != gone}]} for gone in SOURCE],
])
def test_refused(data, tmp_path):
    with pytest.raises(config.ConfigError):
        config.parse(data, tmp_path)


def test_locating(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv(config.ENVIRONMENT, raising=False)
    with pytest.raises(config.ConfigError, match="no configuration"):
        config.load()
    (tmp_path / config.DEFAULT_FILE).write_text(GOOD)
    assert config.load().folder == tmp_path.resolve()
    (tmp_path / "other.toml").write_text(GOOD.replace("data/index", "elsewhere"))
    monkeypatch.setenv(config.ENVIRONMENT, str(tmp_path / "other.toml"))
    assert config.load().db.endswith("elsewhere")
    assert config.load(tmp_path / config.DEFAULT_FILE).db.endswith("data/index")
    (tmp_path / "bad.toml").write_text("db = ")
    with pytest.raises(config.ConfigError):
        config.load(tmp_path / "bad.toml")
