"""Context lines that precede every chunk, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _present(col: Column) -> Column:
    """NULL for empty strings, so that concat_ws leaves the line out."""
    return F.when(col != "", col)


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), _present(value))


def day(doc_date: Column) -> Column:
    return F.substring(F.coalesce(doc_date, F.lit("")), 1, 10)


def file_header(source: Column, path: Column) -> Column:
    return F.concat_ws("/", source, path)


def mail_header(subject: Column, sender: Column, doc_date: Column) -> Column:
    """'subject — sender, date'; an absent sender shows as the word None."""
    return F.concat(
        F.coalesce(_present(subject), F.lit("(no subject)")),
        F.lit(" — "),
        F.coalesce(sender, F.lit("None")),
        F.lit(", "),
        day(doc_date),
    )


def mail_block(meta: Column, subject: Column, doc_date: Column) -> Column:
    """The searchable header block of a message; NULL when it has no header at all."""
    labels = F.when(F.size(meta["labels"]) > 0, F.array_join(meta["labels"], ", "))
    block = F.concat_ws(
        "\n",
        _line("From", meta["from"]),
        _line("To", meta["to"]),
        _line("Cc", meta["cc"]),
        _line("Bcc", meta["bcc"]),
        _line("Reply-To", meta["reply_to"]),
        _line("Subject", subject),
        _line("Date", doc_date),
        _line("Labels", labels),
    )
    return _present(block)


def commit_header(source: Column, sha: Column, author: Column, doc_date: Column) -> Column:
    return F.concat_ws(
        " ", source, F.substring(sha, 1, 7), F.coalesce(author, F.lit("")), day(doc_date)
    )
