"""The three read-only tools of the corpus, as plain functions returning dictionaries."""

from __future__ import annotations

import argparse
import json
from typing import Any

from pyspark.sql import DataFrame

from gleanery import config
from gleanery.engine import Engine, NotFound
from gleanery.session import build_session

_engine: Engine | None = None


def configure(engine: Engine | None) -> None:
    """The engine the tools answer from."""
    global _engine
    _engine = engine


def _current() -> Engine:
    if _engine is None:
        raise RuntimeError("configure() the tools with an engine first")
    return _engine


def _rows(frame: DataFrame) -> list[dict[str, Any]]:
    """Results are bounded by the caller's limit or by one entity's links."""
    return [row.asDict(recursive=True) for row in frame.collect()]


def _vectors(engine: Engine, query: str) -> dict[str, list[float]]:
    try:
        return engine.query_vectors(query) if engine.has_vectors() else {}
    except Exception:  # no key, no client, no network: words still work
        return {}


def search(query: str, sources: list[str] | None = None, since: str = "", until: str = "",
           mode: str = "hybrid", limit: int = 10) -> dict[str, Any]:
    """Documents matching by words and by meaning; falls back to words when there are no vectors."""
    engine = _current()
    vectors = _vectors(engine, query) if mode in ("semantic", "hybrid") else {}
    if mode == "semantic" and not vectors:
        mode = "lexical"
    found = engine.search(
        query, query_vectors=vectors, mode=mode, sources=sources, since=since, until=until, limit=limit
    )
    return {"hits": _rows(found)}


def get_document(source: str, path: str, max_chars: int = 20_000) -> dict[str, Any]:
    """One document's record and content, cut to ``max_chars``."""
    try:
        row = _rows(_current().clipped_document(source, path, max_chars))[0]
    except NotFound:
        return {"error": f"no such document: source={source!r} path={path!r}"}
    return {**row, "meta": json.loads(row["meta"]) if row["meta"] else None}


def related_entities(key: str, kind: str = "", limit: int = 20) -> dict[str, Any]:
    """An entity, what it is linked to and its newest documents."""
    engine = _current()
    entity = engine.entity(key, kind or None).first()
    if entity is None:
        return {"error": f"no such entity: key={key!r}" + (f" kind={kind!r}" if kind else "")}
    documents = engine.entity_documents(entity.kind, entity.key, limit).withColumnRenamed("doc_date", "date")
    return {
        "entity": entity.asDict(),
        "links": _rows(engine.entity_neighbours(entity.kind, entity.key)),
        "documents": _rows(documents),
    }


TOOLS = (search, get_document, related_entities)


def build_app(name: str = "gleanery"):
    """The tools registered with an MCP application; needs the optional ``fastmcp`` package."""
    from fastmcp import FastMCP

    app = FastMCP(name)
    for tool in TOOLS:
        app.tool(tool)
    return app


def main(argv: list[str] | None = None) -> None:
    """Serve the tools over standard input and output."""
    parser = argparse.ArgumentParser(prog="gleanery-tools")
    parser.add_argument("--config", help="configuration file")
    configure(Engine(build_session(), config.load(parser.parse_args(argv).config)))
    build_app().run(transport="stdio")


if __name__ == "__main__":
    main()
