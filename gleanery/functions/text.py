"""Text helpers as Spark column expressions (no Python workers involved, but for declared charsets)."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character str.isspace() accepts; Java's \s and trim() cover fewer.
SPACES = "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())
_SPACES_NOT_NL = SPACES.replace("\n", "")


def char_class(chars: str) -> str:
    """A regex class for ``chars`` that Java and RE2 both read the same way."""
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


WS_CLASS = char_class(SPACES)
WS_IN_LINE_CLASS = char_class(_SPACES_NOT_NL)


def ws(times: str = "") -> str:
    """Java pattern of the same characters; several times faster than the long class."""
    return rf"(?U:[\s\x1c-\x1f]{times})"


def ws_in_line(times: str = "") -> str:
    return rf"(?U:[\s\x1c-\x1f&&[^\n]]{times})"


EXCERPT_CHARS = 200
CHARS_PER_TOKEN = 4

# Which file suffixes are read as text, converted, or listed only.
TEXT_SUFFIXES = (".txt", ".csv", ".md", ".html", ".htm", ".css", ".js", ".xml", ".sh", ".ini")
CODE_SUFFIXES = (
    ".py", ".java", ".ts", ".tsx", ".jsx", ".mjs", ".cjs", ".go", ".rb", ".c",
    ".h", ".cpp", ".cc", ".hpp", ".cs", ".php", ".rs", ".swift", ".kt", ".kts",
    ".scala", ".sql", ".yaml", ".yml", ".json", ".toml", ".gradle", ".m",
    ".mm", ".pl", ".pm", ".lua", ".r", ".jsp", ".vue", ".svelte",
)
CONVERT_SUFFIXES = (".pdf", ".doc", ".docx", ".rtf", ".odt")
HTML_SUFFIXES = (".html", ".htm")
BINARY_SNIFF_BYTES = 8192


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Catalyst inlines a projected column into the lambdas that use it, which
    would re-evaluate it per array element; binding it as a lambda argument
    keeps it a value.
    """
    return F.transform(F.array(value), body)[0]


def strip(col: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(col, F.lit(SPACES))


def squash(col: Column) -> Column:
    """Collapse whitespace runs to one space and strip."""
    return F.btrim(F.regexp_replace(col, ws("+"), " "), F.lit(" "))


def excerpt(text: Column, width: int = EXCERPT_CHARS) -> Column:
    """The first ``width`` characters of the squashed text, marked when cut."""
    def cut(flat: Column) -> Column:
        short = F.concat(F.rtrim(F.substring(flat, 1, width)), F.lit(" ..."))
        return F.when(F.length(flat) <= width, flat).otherwise(short)

    return let(squash(text), cut)


def estimated_tokens(text: Column) -> Column:
    """Four characters count as one token, rounded down."""
    return F.floor(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("long")


def suffix(path: Column) -> Column:
    """Lower-case file suffix with its dot, or '' (dotfiles have none)."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def handling(path: Column) -> Column:
    """'decode', 'convert' or 'metadata': what the suffix allows us to read."""
    ext = suffix(path)
    return (
        F.when(ext.isin(*TEXT_SUFFIXES, *CODE_SUFFIXES), F.lit("decode"))
        .when(ext.isin(*CONVERT_SUFFIXES), F.lit("convert"))
        .otherwise(F.lit("metadata"))
    )


def is_code(path: Column) -> Column:
    return suffix(path).isin(*CODE_SUFFIXES)


def is_commit(path: Column) -> Column:
    return path.startswith("commit/")


def model_kind(path: Column) -> Column:
    """Which embedding space a document belongs to."""
    return F.when(~is_commit(path) & is_code(path), F.lit("code")).otherwise(F.lit("prose"))


def looks_binary(raw: Column) -> Column:
    """True when a NUL byte sits in the sniffed head of the file."""
    return F.contains(F.substring(raw, 1, BINARY_SNIFF_BYTES), F.lit(bytearray(b"\x00")))


def decode_bytes(raw: Column) -> Column:
    """UTF-8 when the bytes are valid UTF-8, else ISO-8859-1; never fails."""
    as_utf8 = raw.cast("string")
    return F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(raw, "ISO-8859-1"))


@F.arrow_udf(T.StringType())
def _decode_by_name(raw: pa.Array, charset: pa.Array) -> pa.Array:
    """Null where the charset is unknown or does not fit."""
    def decoded(body: bytes | None, name: str | None) -> str | None:
        if body is None or name is None:
            return None
        try:
            return body.decode(name)
        except (LookupError, ValueError):  # also names of codecs that are not for text
            return None

    return pa.array(map(decoded, raw.to_pylist(), charset.to_pylist()), pa.string())


def decode_declared(raw: Column, charset: Column) -> Column:
    """As ``decode_bytes``, but bytes that are not UTF-8 are read by their declared charset if that works.

    Charset names are those of Python's codecs, most of which the JVM's expressions do not know; only rows that
    need one leave the JVM.
    """
    needs_name = ~F.is_valid_utf8(raw.cast("string")) & charset.isNotNull()
    named = _decode_by_name(F.when(needs_name, raw), F.when(needs_name, charset))
    return F.coalesce(named, decode_bytes(raw))


def tidy_lines(text: Column) -> Column:
    """Normalise markup-derived text.

    Horizontal whitespace runs become one space, every line is stripped, more
    than one blank line in a row becomes one, and the whole is stripped.
    """
    flat = F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")
    trimmed = F.regexp_replace(flat, f"{ws_in_line('*')}\n{ws_in_line('*')}", "\n")
    return strip(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"))


def strip_quoted_history(text: Column) -> Column:
    """Drop a reply's quoted tail: everything from 'On ... wrote:', then '>' lines."""
    tail = rf"(?imd)^{ws('*')}On{ws()}.{{0,200}}?wrote:{ws('*')}$[\s\S]*"
    unquoted = F.regexp_replace(F.regexp_replace(text, tail, ""), rf"(?md)^{ws_in_line('*')}>.*\n?", "")
    return strip(F.regexp_replace(unquoted, r"\n{3,}", "\n\n"))


def clip(text: Column, max_chars: int) -> tuple[Column, Column]:
    """(text cut to ``max_chars``, whether anything was cut)."""
    return F.substring(text, 1, max_chars), F.length(text) > max_chars
