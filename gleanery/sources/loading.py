"""Reading documents: files, messages, git blobs and commits.

Each loader takes probes and runs inside the tasks that hold them. Python only
reads, hashes and parses; decoding, markup, quoting and everything after that
are Spark expressions. Content that will not be indexed is hashed where it is
read and never enters Spark.
"""

from __future__ import annotations

import email
import email.policy
import hashlib
import os
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.config import Source
from gleanery.functions import markup
from gleanery.functions import text as tx
from gleanery.operators import chunking
from gleanery.sources.conversion import convert
from gleanery.sources.discovery import MailLabels, git

META = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("message_id", "from", "to", "cc", "bcc", "reply_to")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("attachments", "labels")]
    + [T.StructField(n, T.StringType()) for n in ("author_name", "author_email", "committer_name", "committer_email")]
    + [T.StructField("files", T.ArrayType(T.StringType()))]
)
MAIL_META = ("message_id", "from", "to", "cc", "bcc", "reply_to", "attachments", "labels")
COMMIT_META = ("author_name", "author_email", "files")

FLUSH_BYTES = 32 << 20  # content per Arrow batch
_BLOCK = 1 << 20


def _batches(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about ``FLUSH_BYTES``, however large single rows are."""
    held, weight = [], 0
    for row, size in rows:
        held.append(row)
        weight += size
        if weight >= FLUSH_BYTES or len(held) >= 5000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _each(probes: DataFrame, tasks: int, fields: list[tuple[str, T.DataType, pa.DataType]],
          read: Callable[[Iterator[dict]], Iterator[tuple[dict, int]]]) -> DataFrame:
    """Probe columns plus ``fields``, produced by ``read`` from each task's probe rows.

    The probes are shared out here, by number and in path order: what they
    weigh says nothing about what they make the tasks read.
    """
    names = ["path", "stat_sig", "git_sha"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(n, t) for n, t, _ in fields])
    arrow = pa.schema([(n, pa.string()) for n in names] + [(n, t) for n, _, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(read(row for b in batches for row in b.to_pylist()), arrow)

    return probes.repartitionByRange(tasks, "path").mapInArrow(run, schema)


def iso(moment: datetime) -> str:
    return moment.astimezone(timezone.utc).isoformat()


_CONTENT = [
    ("content_hash", T.StringType(), pa.string()),
    ("bytes", T.LongType(), pa.int64()),
    ("doc_date", T.StringType(), pa.string()),
    ("raw", T.BinaryType(), pa.binary()),
    ("converted", T.StringType(), pa.string()),
]


def _suffix(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[1].lower()


def _readable(path: str) -> bool:
    return _suffix(path) in tx.TEXT_SUFFIXES + tx.CODE_SUFFIXES


def _convertible(path: str, enabled: tuple[str, ...]) -> bool:
    return _suffix(path) in tx.CONVERT_SUFFIXES and _suffix(path).lstrip(".") in enabled


def _finish(loaded: DataFrame) -> DataFrame:
    """Text and title of raw contents."""
    path, raw = F.col("path"), F.col("raw")
    decoded = F.when(raw.isNotNull() & ~tx.looks_binary(raw), tx.decode_bytes(raw))
    is_html = tx.suffix(path).isin(*tx.HTML_SUFFIXES)
    with_text = loaded.withColumn("_text", decoded)
    text = F.when(is_html, markup.html_to_text(F.when(is_html, F.col("_text")))).otherwise(
        F.coalesce("_text", "converted")
    )
    return with_text.select(
        "path", "stat_sig", "content_hash", "bytes", "doc_date", tx.basename(path).alias("title"),
        text.alias("text"), F.lit("file").alias("doc_kind"), F.lit(None).cast(META).alias("meta"),
    )


def load_files(probes: DataFrame, source: Source, tasks: int) -> DataFrame:
    root, enabled = source.root, source.convert

    def read(rows: Iterator[dict]) -> Iterator[tuple[dict, int]]:
        for row in rows:
            place = os.path.join(root, row["path"])
            keep = _readable(row["path"])
            digest, size, blocks = hashlib.sha256(), 0, []
            with open(place, "rb") as file:
                while block := file.read(_BLOCK):
                    digest.update(block)
                    size += len(block)
                    if keep:
                        blocks.append(block)
                modified = os.fstat(file.fileno()).st_mtime
            yield {
                **row, "content_hash": digest.hexdigest(), "bytes": size,
                "doc_date": iso(datetime.fromtimestamp(modified, tz=timezone.utc)),
                "raw": b"".join(blocks) if keep else None,
                "converted": convert(place) if _convertible(row["path"], enabled) else None,
            }, size if keep else 0

    return _finish(_each(probes, tasks, _CONTENT, read))


def load_blobs(probes: DataFrame, source: Source, tasks: int) -> DataFrame:
    """Tracked files; one git process per task serves all its blobs."""
    root, enabled = source.root, source.convert

    def converted(path: str, raw: bytes) -> str | None:
        if not _convertible(path, enabled):
            return None
        with tempfile.NamedTemporaryFile(suffix=_suffix(path)) as copy:  # read by the tool within this task
            copy.write(raw)
            copy.flush()
            return convert(copy.name)

    def read(rows: Iterator[dict]) -> Iterator[tuple[dict, int]]:
        with subprocess.Popen(git(root, "cat-file", "--batch"), stdin=subprocess.PIPE, stdout=subprocess.PIPE) as process:
            for row in rows:
                process.stdin.write(row["git_sha"].encode() + b"\n")
                process.stdin.flush()
                size = int(process.stdout.readline().split()[2])
                raw = process.stdout.read(size)
                process.stdout.read(1)
                keep = _readable(row["path"])
                yield {
                    **row, "content_hash": row["git_sha"], "bytes": size, "doc_date": None,
                    "raw": raw if keep else None, "converted": converted(row["path"], raw),
                }, size if keep else 0
            process.stdin.close()

    return _finish(_each(probes, tasks, _CONTENT, read))


_COMMIT_FORMAT = "%x1e%H%x1f%an%x1f%ae%x1f%aI%x1f%s%x1f%B%x1d"  # fixed value: git pretty format


def load_commits(probes: DataFrame, source: Source, tasks: int) -> DataFrame:
    """Commits; one ``git log`` per 500 reads them and the files they touch."""
    root = source.root
    fields = [(n, T.StringType(), pa.string()) for n in ("author_name", "author_email", "authored", "subject", "body")]
    fields.append(("files", T.ArrayType(T.StringType()), pa.list_(pa.string())))

    def read(rows: Iterator[dict]) -> Iterator[tuple[dict, int]]:
        log = git(root, "-c", "core.quotepath=off", "log", "--no-walk=unsorted", "--stdin", "--root",
                  "--no-renames", "--name-only", f"--format={_COMMIT_FORMAT}")
        for some in batched(rows, 500):
            wanted = {row["git_sha"]: row for row in some}
            done = subprocess.run(log, input="\n".join(wanted).encode(), capture_output=True, check=True)
            for record in done.stdout.decode("utf-8", "replace").split("\x1e")[1:]:
                head, files = record.rsplit("\x1d", 1)
                sha, name, address, when, subject, body = head.split("\x1f", 5)
                yield {
                    **wanted[sha], "author_name": name, "author_email": address,
                    "authored": iso(datetime.fromisoformat(when)), "subject": subject, "body": body.rstrip("\n"),
                    "files": [f for f in files.splitlines() if f],
                }, len(record)

    loaded = _each(probes, tasks, fields, read)
    text = F.when(F.col("body") != "", F.col("body")).otherwise(F.col("subject"))
    return loaded.select(
        "path", "stat_sig", F.col("git_sha").alias("content_hash"),
        F.octet_length(text).cast("long").alias("bytes"), F.col("authored").alias("doc_date"),
        F.col("subject").alias("title"), text.alias("text"), F.lit("commit").alias("doc_kind"),
        _meta(COMMIT_META).alias("meta"),
    )


def _meta(present: tuple[str, ...]) -> Column:
    return F.struct(*[
        (F.col(f"`{f.name}`") if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in META
    ])


def path_date(path: str) -> str | None:
    """Midnight UTC of a YYYY/M/D/... path; None when it is not one."""
    parts = path.split("/")
    if len(parts) < 4:
        return None
    try:
        return datetime(*map(int, parts[:3]), tzinfo=timezone.utc).isoformat()
    except ValueError:
        return None


def _message(raw: bytes, path: str) -> dict:
    message = email.message_from_bytes(raw, policy=email.policy.default)

    def header(name: str) -> str | None:
        return None if message[name] is None else str(message[name])

    sent = getattr(message["Date"], "datetime", None)
    if sent is not None and sent.tzinfo is None:
        sent = sent.replace(tzinfo=timezone.utc)
    part = message.get_body(preferencelist=("plain", "html"))
    return {
        "content_hash": hashlib.sha256(raw).hexdigest(), "bytes": len(raw),
        "doc_date": iso(sent) if sent else path_date(path), "subject": header("Subject"),
        "message_id": header("Message-ID"), "from": header("From"), "to": header("To"), "cc": header("Cc"),
        "bcc": header("Bcc"), "reply_to": header("Reply-To"),
        "attachments": [name for p in message.iter_attachments() if (name := p.get_filename())],
        "body": part.get_content() if part is not None else None,
        "is_html": part is not None and part.get_content_type() == "text/html",
    }


_MESSAGE = (
    [("content_hash", T.StringType(), pa.string()), ("bytes", T.LongType(), pa.int64())]
    + [(n, T.StringType(), pa.string()) for n in (
        "doc_date", "subject", "message_id", "from", "to", "cc", "bcc", "reply_to", "body")]
    + [(n, T.ArrayType(T.StringType()), pa.list_(pa.string())) for n in ("attachments", "labels")]
    + [("is_html", T.BooleanType(), pa.bool_())]
)


def mail_labels(spark: SparkSession, root: str) -> DataFrame:
    """``stem, labels`` per message file."""
    spark.dataSource.register(MailLabels)
    rows = spark.read.format("mail_labels").options(root=root).load()
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "labels"))), lambda r: r["labels"]))
    return rows.groupBy("stem").agg(
        F.when(F.bool_or("alone"), F.max_by("labels", "n")).otherwise(listed).alias("labels")
    )


def load_messages(probes: DataFrame, source: Source, tasks: int) -> DataFrame:
    root = source.root

    def read(rows: Iterator[dict]) -> Iterator[tuple[dict, int]]:
        for row in rows:
            with open(os.path.join(root, row["path"]), "rb") as file:
                raw = file.read()
            yield {**row, **_message(raw, row["path"])}, len(raw)

    # Labels join the probes, not the messages: no message text is ever shuffled.
    stem = F.regexp_replace(tx.basename(F.col("path")), r"(?<=.)\.[^.]+\z", "")
    labelled = probes.select("path", "stat_sig", "git_sha", stem.alias("stem")).join(
        mail_labels(probes.sparkSession, root), "stem", "left"
    ).select("path", "stat_sig", "git_sha", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))
    loaded = _each(labelled, tasks, _MESSAGE, read)
    is_html = F.col("is_html")
    plain = F.when(is_html, markup.html_to_text(F.when(is_html, F.col("body")))).otherwise(F.col("body"))
    text = tx.let(tx.strip_quoted_history(plain), lambda t: F.when(t != "", t))
    return loaded.select(
        "path", "stat_sig", "content_hash", "bytes", "doc_date", F.col("subject").alias("title"),
        text.alias("text"), F.lit("mail").alias("doc_kind"), _meta(MAIL_META).alias("meta"),
    )


def load(probes: DataFrame, source: Source, tasks: int) -> DataFrame:
    """Loaded documents of one source, read by ``tasks`` tasks.

    ``source, path, stat_sig, content_hash, bytes, doc_date, title, text,
    doc_kind, layout, meta, meta_json``.
    """
    if source.type == "filetree":
        loaded = load_files(probes, source, tasks)
    elif source.type == "eml_tree":
        loaded = load_messages(probes, source, tasks)
    else:
        commit = tx.is_commit(F.col("path"))
        loaded = load_blobs(probes.where(~commit), source, tasks).unionByName(
            load_commits(probes.where(commit), source, tasks)
        )

    def chosen(fields: tuple[str, ...]) -> Column:
        picked = F.struct(*[F.col(f"meta.`{f}`").alias(f) for f in fields])
        return F.to_json(picked, {"ignoreNullFields": "false"})

    as_json = (
        F.when(F.col("doc_kind") == "mail", chosen(MAIL_META))
        .when(F.col("doc_kind") == "commit", chosen(COMMIT_META))
        .otherwise(F.lit("{}"))
    )
    return loaded.select(
        F.lit(source.name).alias("source"), "path", "stat_sig", "content_hash", "bytes", "doc_date", "title", "text",
        "doc_kind", chunking.layout_for(F.lit(source.type), F.col("path")).alias("layout"), "meta",
        as_json.alias("meta_json"),
    )
