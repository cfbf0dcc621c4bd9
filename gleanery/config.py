"""The TOML configuration: which sources to index, with which models and entity files."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

ENVIRONMENT = "GLEANERY_CONFIG"
DEFAULT_FILE = "gleanery.toml"

# Source types, default models and their vector size.
SOURCE_TYPES = ("filetree", "eml_tree", "gitrepo")
PROSE_MODEL, CODE_MODEL = "voyage-3.5", "voyage-code-3"
DIMENSIONS = 1024

_ROOT_KEYS = {"db": str, "sources": list, "models": dict, "entities": dict}
_SOURCE_KEYS = {
    "name": str, "type": str, "root": str, "include": list, "exclude": list,
    "branch": str, "convert": list, "embed": bool, "embed_exclude": list,
}
_MODEL_KEYS = {"prose": str, "code": str}
_ENTITY_KEYS = {"seeds": str, "aliases": str}


class ConfigError(ValueError):
    """The configuration is missing or wrong."""


@dataclass(frozen=True)
class Source:
    name: str
    type: str
    root: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    branch: str | None = None
    convert: tuple[str, ...] = ()
    embed: bool = True
    embed_exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    db: str
    sources: tuple[Source, ...]
    prose_model: str = PROSE_MODEL
    code_model: str = CODE_MODEL
    seeds: str | None = None
    aliases: str | None = None
    folder: Path = field(default_factory=Path.cwd)

    def source(self, name: str) -> Source:
        found = {s.name: s for s in self.sources}
        return found[name]

    @property
    def models(self) -> dict[str, str]:
        return {"prose": self.prose_model, "code": self.code_model}

    @property
    def embed_rules(self) -> dict[str, tuple[str, ...]]:
        """Embeddable sources and the path globs that stay out."""
        return {s.name: s.embed_exclude for s in self.sources if s.embed}


def _checked(raw: Any, allowed: Mapping[str, type], where: str, required: tuple[str, ...] = ()) -> dict:
    """``raw`` if it is a table with only ``allowed`` keys of the right types."""
    if not isinstance(raw, dict):
        raise ConfigError(f"{where} must be a table, not {type(raw).__name__}")
    if extra := sorted(raw.keys() - allowed.keys()):
        raise ConfigError(f"{where} has unknown keys: {', '.join(extra)}")
    if missing := [k for k in required if k not in raw]:
        raise ConfigError(f"{where} lacks: {', '.join(missing)}")
    for key, value in raw.items():
        if not isinstance(value, allowed[key]):
            raise ConfigError(f"{where}: {key} must be a {allowed[key].__name__}, got {value!r}")
        if allowed[key] is list and key != "sources" and not all(isinstance(v, str) for v in value):
            raise ConfigError(f"{where}: {key} must hold strings only")
    return raw


def _placed(path: str, folder: Path) -> str:
    """An absolute path or URI as given; anything else relative to the config's folder."""
    if "://" in path:
        return path
    return str((folder / Path(path).expanduser()).resolve())


def _source(raw: Any, n: int, folder: Path) -> Source:
    table = _checked(raw, _SOURCE_KEYS, f"source #{n}", ("name", "type", "root"))
    where = f"source {table['name']!r}"
    if not table["name"]:
        raise ConfigError(f"source #{n} has an empty name")
    if table["type"] not in SOURCE_TYPES:
        raise ConfigError(f"{where}: type must be one of {', '.join(SOURCE_TYPES)}")
    if "://" in table["root"]:  # tasks list and read sources as folders; only the index may lie behind a URI
        raise ConfigError(f"{where}: root must be a folder that every task sees, not {table['root']}")
    if "branch" in table and table["type"] != "gitrepo":
        raise ConfigError(f"{where}: only a gitrepo has a branch")
    convert = tuple(s.lower().lstrip(".") for s in table.get("convert", ()))
    if "" in convert:
        raise ConfigError(f"{where}: convert names an empty suffix")
    lists = {k: tuple(table.get(k, ())) for k in ("include", "exclude", "embed_exclude")}
    return Source(
        table["name"], table["type"], _placed(table["root"], folder),
        branch=table.get("branch"), convert=convert, embed=table.get("embed", True), **lists,
    )


def parse(data: Any, folder: Path) -> Config:
    root = _checked(data, _ROOT_KEYS, "the configuration", ("db",))
    if not root.get("sources"):
        raise ConfigError("the configuration needs at least one [[sources]] table")
    sources = tuple(_source(raw, n, folder) for n, raw in enumerate(root["sources"], start=1))
    names = [s.name for s in sources]
    if len(set(names)) < len(names):
        raise ConfigError(f"source names repeat: {', '.join(sorted({n for n in names if names.count(n) > 1}))}")
    models = _checked(root.get("models", {}), _MODEL_KEYS, "[models]")
    files = _checked(root.get("entities", {}), _ENTITY_KEYS, "[entities]")
    return Config(
        db=_placed(root["db"], folder),
        sources=sources,
        prose_model=models.get("prose", PROSE_MODEL),
        code_model=models.get("code", CODE_MODEL),
        folder=folder,
        **{k: _placed(v, folder) for k, v in files.items()},
    )


def locate(explicit: str | os.PathLike | None = None) -> Path:
    """An explicit path, else the environment's, else the file in the current folder."""
    return Path(explicit or os.environ.get(ENVIRONMENT) or DEFAULT_FILE).expanduser()


def load(explicit: str | os.PathLike | None = None) -> Config:
    path = locate(explicit)
    if not path.is_file():
        raise ConfigError(f"no configuration at {path}")
    try:
        data = tomllib.loads(path.read_text("utf-8"))
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as error:
        raise ConfigError(f"{path}: {error}") from error
    return parse(data, path.resolve().parent)
