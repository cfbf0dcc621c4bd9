"""Seed names and aliases from the operator's TOML files, and the alias review file."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame

from gleanery.operators.entities import Aliases, Seeds


def _table(path: str | None) -> dict:
    file = Path(path) if path else None
    return tomllib.loads(file.read_text("utf-8")) if file and file.is_file() else {}


def load_seeds(path: str | None) -> Seeds:
    table = _table(path)
    return Seeds(tuple(map(str, table.get("persons", ()))), tuple(map(str, table.get("orgs", ()))))


def load_aliases(path: str | None) -> Aliases:
    table = _table(path)
    texts = {k: {str(a): str(b) for a, b in table.get(k, {}).items()} for k in ("alias_of", "member_of")}
    return Aliases(**texts)


def _quoted(value: str) -> str:
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def write_alias_review(review: DataFrame, path: str, top_n: int) -> None:
    """The review file: rows stream to it one partition at a time, in order."""
    with open(path, "w", encoding="utf-8") as out:
        out.write(
            f"# Addresses to review and prune into an aliases file: the top {top_n} correspondents\n"
            "# by document count and every git author. Put the person's name on the right of\n"
            "# each '=', drop the lines that need none, and add a [member_of] table that maps\n"
            "# person names to organisation names.\n\n[alias_of]\n"
        )
        for row in review.toLocalIterator():
            out.write(f"{_quoted(row['key'])} = {_quoted(row['display'])}  # {row['n']} documents, {row['tags']}\n")
