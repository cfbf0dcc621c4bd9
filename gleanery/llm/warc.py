"""WARC archives: writing records and reading them back sequentially.

Every record is one gzip member. Archives are written by Spark's text writer, one record per row, as
raw bytes; the writer puts a separator behind each row, and a gzip member ends with the high byte of its length,
which is 0 below 16 MB. So the separator is that zero byte, and a larger member is followed by an
empty one, which ends in zeros too. What results are ordinary .warc.gz files in any file system that Spark
reaches. The reader takes a file's bytes front to back: it inflates a member in steps, frames the block by
Content-Length and checks its digests; no more than one record is held.

Of records with equal payloads of at least REVISIT_BYTES, that with the largest page id is a response
and the others are revisits of it (headers only). Equal payloads are found by digest and length; only pages whose
payload occurs twice are shuffled.

Defined results: a null html is an empty payload; a null url has no target header; pages with null ids
keep a null id (they never win over another id; if a group has no id at all, all its pages are responses). Rows
that repeat the id that wins are all responses. An empty table gives an empty archive and result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.shared import marked, quoted, scratch, sieve, with_groups

REVISIT_BYTES = 1000
#: Records of one archive at most: bounds the file that one reader holds.
RECORDS_PER_FILE = 500
STEP = 1 << 16
DATE = "2024-01-01T00:00:00Z"
EMPTY_MEMBER = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0]) + bytes(8)
RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType())])


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, digest and the page that each page refers to (null: it is a response)."""
    body = F.coalesce(quoted(html), F.lit(""))
    rows = pages.select(
        quoted(page_id).cast("long").alias("page_id"), quoted(url).alias("url"), body.alias("html"),
        F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    groups = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(
        F.max("size").alias("size"), F.max("page_id").alias("winner"), F.count("*").alias("copies")).where("copies > 1")
    seen = marked(rows, sieve(groups.select("digest")), [F.col("digest")], "twin")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("winner")), F.col("winner"))
    twins = with_groups(seen.where("twin"), "digest", "size", groups, "left").withColumn("refers_to", refers)
    alone = seen.where("NOT twin").withColumn("refers_to", F.lit(None).cast("long"))
    columns = ["page_id", "url", "html", "digest", "size", "refers_to"]
    return alone.select(columns).union(twins.select(columns))


def record_name(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=page_id % (1 << 64))}>"


def named_page(name: str | None) -> int | None:
    if name is None:
        return None
    value = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).int
    return value - (1 << 64) if value >= 1 << 63 else value


def base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member (and an empty one where the last byte is not zero)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Date", DATE),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>" if page_id is None else record_name(page_id)),
        ("WARC-Payload-Digest", base32(digest)), ("WARC-Block-Digest", base32(hashlib.sha1(block).hexdigest())),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if page_id is None:
        headers.append(("X-No-Page", "1"))
    if url is not None:
        headers.append(("WARC-Target-URI", " ".join(url.split())))
    if revisit:
        headers += [("WARC-Refers-To", record_name(refers_to)),
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()
    return member if member[-1] == 0 else member + EMPTY_MEMBER


def write(pages: DataFrame, folder: str, **names: str) -> None:
    """Archives of all ``pages`` under ``folder``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 32):
                part = batch.slice(begin, 32)
                columns = (part.column(n) for n in ("page_id", "url", "html", "digest", "refers_to"))
                members = [
                    record(p.as_py(), u.as_py(), h.as_py().encode(), d.as_py(), r.as_py())[:-1]
                    for p, u, h, d, r in zip(*columns, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["member"])

    rows = planned(pages, **names).select("page_id", "url", "html", "digest", "refers_to")
    members = rows.mapInArrow(run, "member binary").select(F.col("member").cast("string"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def inflated(data: bytes) -> Iterator[bytes]:
    """The decompressed bytes of one member after another, in steps; b"" marks the end of a member."""
    at, view = 0, memoryview(data)
    while at < len(view):
        inflater = zlib.decompressobj(31)
        while not inflater.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a record")
            chunk = view[at:at + STEP]
            yield inflater.decompress(chunk)
            at += len(chunk) - len(inflater.unused_data)
        yield b""


def records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record, framed by Content-Length."""
    held, headers = bytearray(), None
    for chunk in chunks:
        held += chunk
        if headers is None and (end := held.find(b"\r\n\r\n")) >= 0:
            version, *lines = held[:end].decode().split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            del held[:end + 4]
        if chunk == b"" and (headers is not None or held):
            length = int(headers["content-length"]) if headers else -1
            if length < 0 or held[length:] != b"\r\n\r\n":
                raise ValueError("the record's length is wrong")
            yield headers, bytes(held[:length])
            held, headers = bytearray(), None


def parsed(headers: dict[str, str], block: bytes) -> tuple:
    """A row of RECORD, its digests verified."""
    if base32(hashlib.sha1(block).hexdigest()) != headers["warc-block-digest"]:
        raise ValueError("the block digest is wrong")
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    kind = headers["warc-type"]
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload digest is wrong")
    page = None if "x-no-page" in headers else named_page(headers["warc-record-id"])
    return page, size, digest, kind, named_page(headers.get("warc-refers-to")), headers.get("warc-target-uri"), payload


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the archives under ``folder``."""
    schema = RECORD if payloads else T.StructType(RECORD.fields[:-1])
    width = len(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for headers, block in records(inflated(content.as_py())):
                    rows.append(parsed(headers, block)[:width])
                    if len(rows) == 64:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    columns = [pa.array(values, kinds[f.dataType]) for values, f in zip(zip(*rows, strict=True), schema.fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def archive_round_trip(pages: DataFrame, **names: str) -> DataFrame:
    """Writes archives of ``pages`` to the shared folder and reads them back, without payloads."""
    spark = pages.sparkSession
    scratch(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4()}"
    write(pages, folder, **names)
    return read(spark, folder, payloads=False).drop("url")
