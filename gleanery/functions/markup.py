"""HTML to text: an Arrow function emits the raw text, Spark tidies it."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.text import tidy_lines

# Elements whose content is dropped, and elements that break lines.
DROPPED = ("script", "style")
LINE_BREAKING = (
    "p", "div", "br", "hr", "li", "tr", "table", "ul", "ol",
    "h1", "h2", "h3", "h4", "h5", "h6",
    "blockquote", "pre", "section", "article", "header", "footer",
)


class _Reader(HTMLParser):
    """Keeps visible character data and one newline per line-breaking tag."""

    depth = 0  # open dropped elements

    def visible(self, markup: str) -> str:
        self.pieces: list[str] = []
        self.feed(markup)
        self.close()
        return "".join(self.pieces)

    def _tag(self, tag: str, nesting: int) -> None:
        if tag in LINE_BREAKING:
            self.pieces.append("\n")
        elif tag in DROPPED:
            self.depth = max(self.depth + nesting, 0)

    def handle_starttag(self, tag, attrs):
        self._tag(tag, +1)

    def handle_endtag(self, tag):
        self._tag(tag, -1)

    def handle_startendtag(self, tag, attrs):
        self._tag(tag, 0)

    def handle_data(self, data):
        if not self.depth:
            self.pieces.append(data)


@F.arrow_udf(T.StringType())
def visible_text(markup: pa.Array) -> pa.Array:
    return pa.array(
        [None if m is None else _Reader().visible(m) for m in markup.to_pylist()], pa.string()
    )


def html_to_text(markup: Column) -> Column:
    return tidy_lines(visible_text(markup))
