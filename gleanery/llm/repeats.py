"""Repeated passages: bytes covered by a 50-byte string that also starts in a document with a smaller id.

Prefix doubling names the strings at every position by rank pairs at growing offsets. This is winnowing in its place: no
ranks, no doubling rounds. The names are 64-bit hashes, which need no global renumbering, the threshold is 50 bytes, and positions whose name is
unique leave at once, so that the later names are made only for the few that are left:

1. Names of K = 20 bytes, for a sparse set of positions. Of the 31 positions of K-byte strings inside a 50-byte
   string, the one with the least name is its anchor. Equal 50-byte strings have equal anchors, so strings
   whose anchor is unique are unique. One position in 16 is an anchor.
2. An anchor serves a run of successive strings. Where the whole run (50 to 80 bytes) has been seen in a document with a
   smaller id, all its strings are removed: this settles the inside of copies and passages.
3. Names of 50 bytes, for every position of the runs whose anchor occurs again with another run: the
   ends of passages, and chance.

Only anchors are shuffled, packed by name into many small groups; a map task keeps one document's anchors
of a run that occurs in many of its documents, so the inside of a passage in a third of all documents adds a row per
batch. At the ends of such a passage every document has a run of its own: of an anchor with more than HOT rows
in a slice, of several runs, at most four go to its group, and the others to step 3 at once. There, strings are
dealt by their own names, and of a name that occurs in many documents of a map task one document's strings go on. Texts move once or twice, and only those of documents that have something to compare or to remove.

Defined results: null texts are empty. Documents with null ids neither lose nor cause anything. Rows
that share an id never remove from each other (their texts are told apart by a 64-bit checksum). Empty tables, empty and
very long texts work; long ones are read in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.hashing import column_bytes, mix, prefix_sums, random_table, slices, span_hashes
from gleanery.llm.shared import marked, quoted, saved, sieve

LENGTH, K = 50, 20
#: Text behind one shuffle group, and text that a task looks at at once.
GROUP_BYTES, SLICE = 1 << 21, 1 << 21
_U = np.uint64
_BYTES = random_table(23, 256)
#: Rows of an anchor of several runs that a slice sends to the anchor's group.
HOT = 8
ANCHORS, RANGES, OPEN = 0, 1, 2
PACKED = "kind int, bucket int, body binary"
#: Columns of packed rows.
ANCHOR = (("h", "<u4"), ("c", "<u4"), ("d", "<u2"), ("lo", "<u4"), ("n", "u1"))
RANGE = (("lo", "<u4"), ("hi", "<u4"))
NAME = (("h", "<u4"), ("c", "<u4"), ("lo", "<u4"))
#: What names a text: its document, and a 64-bit checksum where rows with one id may have several texts (else 0).
TEXT = ("doc", "tag")
Rows = dict[str, np.ndarray]


def pack(rows: Rows, layout: tuple) -> bytes:
    """The texts of the rows once each, then the rows with the place of their text: a bit per row where they come text by text.

    Numbers lie byte by byte (all lowest bytes first): those that are mostly zero, as of ids and places, then compress to nothing.
    """
    doc, tag = (rows[name].astype("<i8") for name in TEXT)
    order = np.lexsort((tag, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (tag[order][1:] != tag[order][:-1])
    first = order[new]
    if ordered := bool((order[1:] > order[:-1]).all()):
        place = np.packbits(new)
    else:
        place = np.zeros(len(order), "<u4")
        place[order] = np.cumsum(new) - 1
    return b"".join([
        np.array([len(order), len(first), ordered], "<u4").tobytes(), _planes(doc[first]), _planes(tag[first]),
        _planes(place), *[_planes(rows[name].astype(kind)) for name, kind in layout]])


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpack(bodies: Iterator[bytes], layout: tuple) -> Rows:
    parts: dict[str, list[np.ndarray]] = {name: [] for name in (*TEXT, *(name for name, _ in layout))}
    for body in bodies:
        n, texts, ordered = np.frombuffer(body, "<u4", 3).tolist()
        at = 12

        def column(rows: int, kind: str) -> np.ndarray:
            nonlocal at
            size = np.dtype(kind).itemsize
            planes = np.frombuffer(body, np.uint8, rows * size, at).reshape(size, rows)
            at += rows * size
            return np.ascontiguousarray(planes.T).reshape(-1).view(kind)

        doc, tag = column(texts, "<i8"), column(texts, "<i8")
        place = np.cumsum(np.unpackbits(column((n + 7) // 8, "u1"), count=n), dtype=np.int64) - 1 if ordered else column(n, "<u4")
        parts["doc"].append(doc[place])
        parts["tag"].append(tag[place])
        for name, kind in layout:
            parts[name].append(column(n, kind))
    kinds = {**dict.fromkeys(TEXT, "<i8"), **dict(layout)}
    return {name: np.concatenate(parts[name]) if parts[name] else np.zeros(0, kind) for name, kind in kinds.items()}


def dealt(rows: Rows, layout: tuple, bucket: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """Packed rows, one per bucket, text by text."""
    order = np.lexsort((rows["lo"], rows["tag"], rows["doc"], bucket))
    bucket = bucket[order]
    rows = {name: rows[name][order] for name in (*TEXT, *(name for name, _ in layout))}
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
    ends = np.concatenate([starts[1:], [len(bucket)]])
    bodies = [pack({k: v[s:e] for k, v in rows.items()}, layout) for s, e in zip(starts, ends, strict=True)] if len(bucket) else []
    if bodies:
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(bodies), kind, np.int32)), pa.array(bucket[starts].astype(np.int32)),
            pa.array(bodies, pa.binary())], names=["kind", "bucket", "body"])


def joined_ranges(rows: Rows) -> Rows:
    """Touching and overlapping ranges of a text as one."""
    order = np.lexsort((rows["lo"], rows["tag"], rows["doc"]))
    rows = {k: v[order] for k, v in rows.items()}
    if not len(order):
        return rows
    new_text = np.concatenate([[True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["tag"][1:] != rows["tag"][:-1])])
    # Running maximum of the ends inside each text: texts are lifted over one another by their number.
    lift = np.cumsum(new_text).astype(np.int64) << 33
    reach = np.maximum.accumulate(rows["hi"].astype(np.int64) + lift)
    starts = new_text.copy()
    starts[1:] |= rows["lo"][1:].astype(np.int64) + lift[1:] > reach[:-1]
    first = np.flatnonzero(starts)
    last = np.concatenate([first[1:], [len(order)]]) - 1
    out = {k: rows[k][first] for k in ("doc", "tag", "lo")}
    return out | {"hi": (reach[last] - lift[last]).astype(np.int64)}


def runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first and last position, anchor name and run name of every run in the rows ``bounds`` of ``data``."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    sums = prefix_sums(data, _BYTES)
    starts = np.arange(n - K + 1)
    value, place = span_hashes(sums, starts, starts + K), starts
    width, span = 1, LENGTH - K + 1
    while width * 2 <= span:
        value, place = _least(value, place, width)
        width *= 2
    if width < span:
        value, place = _least(value, place, span - width)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:len(value)]
    inside = np.arange(len(value)) + LENGTH <= bounds[row + 1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    lo, hi = np.flatnonzero(begins), np.flatnonzero(ends)
    whole = mix(span_hashes(sums, lo, hi + LENGTH) + (place[lo] - lo).astype(_U))
    return row[lo], lo, hi, value[lo], whole


def _least(value: np.ndarray, place: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry and the one ``shift`` further, the lesser value and its place (the left one if equal)."""
    right = value[shift:] < value[:-shift]
    return np.where(right, value[shift:], value[:-shift]), np.where(right, place[shift:], place[:-shift])


def checksum(data: np.ndarray, several: bool = True) -> int:
    return several and int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def found_runs(ids: np.ndarray, several: list[bool], data: np.ndarray, offsets: np.ndarray) -> Iterator[Rows]:
    """The runs of a batch of texts, slice by slice: doc, tag, lo, n (positions less one), h and c (names)."""
    for first, last in slices(offsets, SLICE):
        begin, end = int(offsets[first]), int(offsets[last])
        tags = np.array([checksum(data[offsets[i]:offsets[i + 1]], several[i]) for i in range(first, last)], np.int64)
        # A longer text comes in pieces that share LENGTH - 1 bytes.
        for at in range(begin, max(begin + 1, end - LENGTH + 1), 2 * SLICE) if end - begin > 2 * SLICE else (begin,):
            stop = min(end, at + 2 * SLICE + LENGTH - 1) if end - begin > 2 * SLICE else end
            bounds = np.array([0, stop - at]) if end - begin > 2 * SLICE else offsets[first:last + 1] - begin
            row, lo, hi, h, c = runs(data[at:stop], bounds)
            yield {"doc": ids[first + row], "tag": tags[row], "lo": lo - bounds[row] + at - begin, "n": hi - lo, "h": h, "c": c}


def crowded(rows: Rows) -> np.ndarray:
    """Which of a slice's ``rows`` need not go to the group of their anchor: it is known to have several runs.

    The rows that stay show the group that there are several runs, and several documents if so: the anchor's least
    and greatest in both. The group then leaves open all runs of the anchor that it does not settle.
    """
    _, name = np.unique(rows["h"], return_inverse=True)
    out = np.zeros(len(name), bool)
    several = np.zeros(name.max(initial=-1) + 1, bool)
    for field in ("c", "doc"):
        order = np.lexsort((rows[field], name))
        new = np.concatenate([[True], name[order][1:] != name[order][:-1]]) if len(order) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(order)]])[:len(first)] - 1
        if field == "c":
            several = (rows["c"][order[first]] != rows["c"][order[last]]) & (last - first >= HOT)
            out = several[name]
        out[order[first]] = out[order[last]] = False
    return out


def anchors(docs: DataFrame, groups: int) -> DataFrame:
    """Packed anchors by name, and the ranges that a batch settles by itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows in found_runs(ids, batch.column(2).to_pylist(), *column_bytes(batch.column(1))):
                _, same = np.unique(rows["c"], return_inverse=True)
                least = np.full(same.max(initial=-1) + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, same, rows["doc"])
                later = rows["doc"] > least[same]
                gone = {k: rows[k][later] for k in ("doc", "tag", "lo")}
                gone = joined_ranges(gone | {"hi": gone["lo"] + rows["n"][later] + LENGTH})
                yield from dealt(gone, RANGE, gone["doc"] % groups, RANGES)
                kept = {k: v[~later] for k, v in rows.items()}
                spare = crowded(kept)
                left = {k: kept[k][spare] for k in ("doc", "tag", "lo")}
                left = joined_ranges(left | {"hi": left["lo"] + kept["n"][spare] + LENGTH})
                yield from dealt(left, RANGE, left["doc"] % groups, OPEN)
                kept = {k: v[~spare] for k, v in kept.items()}
                bucket = ((kept["h"] >> _U(32)) % _U(groups)).astype(np.int64)
                kept |= {"h": kept["h"] & _U(0xFFFFFFFF), "c": kept["c"] & _U(0xFFFFFFFF), "d": kept["c"] >> _U(48)}
                yield from dealt(kept, ANCHOR, bucket, ANCHORS)

    return docs.select("doc_id", "text", _several(docs)).mapInArrow(run, PACKED)


def settled(packed: DataFrame, groups: int) -> DataFrame:
    """Per name: the ranges of runs known from a smaller id, and the runs that are still open."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        schema = table.schema
        if key[0].as_py() != ANCHORS:
            return table
        rows = unpack((b.as_py() for b in table.column("body")), ANCHOR)
        run_name = rows["c"].astype(_U) << _U(16) | rows["d"].astype(_U)
        order = np.lexsort((rows["doc"], run_name, rows["h"]))
        rows, run_name = {k: v[order] for k, v in rows.items()}, run_name[order]
        new_name = np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]])
        new_run = new_name | np.concatenate([[True], run_name[1:] != run_name[:-1]])
        least = rows["doc"][np.flatnonzero(new_run)][np.cumsum(new_run) - 1]
        later = rows["doc"] > least
        gone = {k: rows[k][later].astype(np.int64) for k in ("doc", "tag", "lo")}
        gone = joined_ranges(gone | {"hi": gone["lo"] + rows["n"][later] + LENGTH})
        name = np.cumsum(new_name) - 1
        first = np.flatnonzero(new_name)
        several_runs = np.add.reduceat(new_run.astype(np.int64), first) > 1
        several_docs = np.minimum.reduceat(rows["doc"], first) < np.maximum.reduceat(rows["doc"], first)
        still = (several_runs & several_docs)[name] & ~later
        left = {k: rows[k][still].astype(np.int64) for k in ("doc", "tag", "lo")}
        left["hi"] = left["lo"] + rows["n"][still] + LENGTH
        left = joined_ranges(left)
        parts = [*dealt(gone, RANGE, gone["doc"] % groups, RANGES), *dealt(left, RANGE, left["doc"] % groups, OPEN)]
        return pa.Table.from_batches(parts, parts[0].schema).cast(schema) if parts else schema.empty_table()

    return packed.groupBy("kind", "bucket").applyInArrow(run, PACKED)


def _strings(held: list[tuple[int, int, int, np.ndarray]]) -> tuple[Rows, np.ndarray]:
    """All 50-byte strings of the pieces ``held`` (doc, tag, first position, bytes), and their names."""
    data = np.concatenate([h[3] for h in held])
    sizes = np.array([len(h[3]) for h in held])
    counts = np.maximum(sizes - LENGTH + 1, 0)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(np.cumsum(sizes) - sizes, counts) + within
    names = span_hashes(prefix_sums(data, _BYTES), starts, starts + LENGTH)
    doc, tag, begin = (np.repeat(np.array([h[i] for h in held], np.int64), counts) for i in range(3))
    return {"doc": doc, "tag": tag, "lo": begin + within}, names


def _later(rows: Rows, name: np.ndarray) -> tuple[np.ndarray, Rows]:
    """Which strings have a name that a smaller id has, and their ranges."""
    order = np.lexsort((rows["doc"], name))
    doc, ordered = rows["doc"][order], name[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(order) else np.zeros(0, bool)
    later = np.zeros(len(order), bool)
    later[order] = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    gone = {k: rows[k][later].astype(np.int64) for k in ("doc", "tag", "lo")}
    return later, joined_ranges(gone | {"hi": gone["lo"] + LENGTH})


def named(docs: DataFrame, ranges: DataFrame, groups: int) -> DataFrame:
    """Names of all 50-byte strings inside ``ranges``, dealt by name, and the ranges that a task settles by itself."""
    def run(key: tuple, texts: pa.Table, table: pa.Table) -> pa.Table:
        wanted = joined_ranges(unpack((b.as_py() for b in table.column("body")), RANGE))
        made: list[tuple[Rows, np.ndarray]] = []
        held: list[tuple[int, int, int, np.ndarray]] = []
        size = 0
        for doc, tag, data in _texts(texts):
            for i in range(*np.searchsorted(wanted["doc"], [doc, doc + 1])):
                lo, hi = int(wanted["lo"][i]), int(wanted["hi"][i])
                if wanted["tag"][i] == tag and hi <= len(data):
                    held.append((doc, tag, lo, data[lo:hi]))
                    size += hi - lo
            if size > SLICE:
                made.append(_strings(held))
                held, size = [], 0
        if held:
            made.append(_strings(held))
        schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary())])
        if not made:
            return schema.empty_table()
        rows = {k: np.concatenate([m[0][k] for m in made]) for k in ("doc", "tag", "lo")}
        name = np.concatenate([m[1] for m in made])
        later, gone = _later(rows, name)
        rows, name = {k: v[~later] for k, v in rows.items()}, name[~later]
        rows |= {"h": name & _U(0xFFFFFFFF), "c": name >> _U(32)}
        bucket = ((name >> _U(32)) % _U(groups)).astype(np.int64)
        parts = [*dealt(gone, RANGE, gone["doc"] % groups, RANGES), *dealt(rows, NAME, bucket, ANCHORS)]
        return pa.Table.from_batches(parts, parts[0].schema).cast(schema) if parts else schema.empty_table()

    return _with_texts(docs, ranges, run, PACKED)


def known_names(packed: DataFrame, groups: int) -> DataFrame:
    """The ranges of the strings whose name a smaller id has."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() != ANCHORS:
            return table
        rows = unpack((b.as_py() for b in table.column("body")), NAME)
        _, gone = _later(rows, rows["c"].astype(_U) << _U(32) | rows["h"].astype(_U))
        parts = list(dealt(gone, RANGE, gone["doc"] % groups, RANGES))
        return pa.Table.from_batches(parts, parts[0].schema).cast(table.schema) if parts else table.schema.empty_table()

    return packed.groupBy("kind", "bucket").applyInArrow(run, PACKED)


def _texts(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """Id, checksum and bytes of each row that has an id."""
    for batch in table.select(["doc_id", "text", "several"]).to_batches():
        data, offsets = column_bytes(batch.column(1))
        for i, (doc, several) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if doc is not None:
                body = data[offsets[i]:offsets[i + 1]]
                yield doc, checksum(body, several), body


def _documents(ranges: DataFrame) -> DataFrame:
    """The ids of the documents that ``ranges`` touch, each once: all ranges of a document lie in one bucket."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = np.unique(unpack((b.as_py() for b in table.column("body")), RANGE)["doc"])
        return pa.table([pa.array(ids.astype(np.int64))], names=["doc_id"])

    return ranges.select("bucket", "body").groupBy("bucket").applyInArrow(run, "doc_id long")


def _several(docs: DataFrame) -> Column:
    """Whether rows with this id may have several texts; true where nobody looked."""
    return F.col("several") if "several" in docs.columns else F.lit(True).alias("several")


def _by_group(docs: DataFrame, groups: int) -> DataFrame:
    return docs.select(F.pmod("doc_id", F.lit(groups)).cast("int").alias("bucket"), "doc_id", "text", _several(docs))


def _with_texts(texts: DataFrame, ranges: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on the texts and ranges of a few documents at a time."""
    return texts.groupBy("bucket").cogroup(ranges.groupBy("bucket")).applyInArrow(run, schema)


def without(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """What is left of the texts of ``docs``."""
    def run(key: tuple, texts: pa.Table, table: pa.Table) -> pa.Table:
        gone = joined_ranges(unpack((b.as_py() for b in table.column("body")), RANGE))
        out: list[tuple] = []
        for doc, tag, data in _texts(texts):
            chosen = slice(*np.searchsorted(gone["doc"], [doc, doc + 1]))
            mine = gone["tag"][chosen] == tag
            lo, hi = gone["lo"][chosen][mine].tolist(), gone["hi"][chosen][mine].tolist()
            digest, at = hashlib.sha256(), 0
            for a, b in zip(lo, hi, strict=True):
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            out.append((doc, len(data), sum(hi) - sum(lo), len(lo), digest.hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return _with_texts(docs, ranges, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = docs.select(quoted(doc_id).cast("long").alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    # Ids of several rows; the sieve may hold a few others, whose texts then have a checksum for nothing.
    docs = marked(docs, sieve(docs.groupBy("doc_id").count().where("count > 1").select("doc_id")), [F.col("doc_id")], "several")
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups = total // GROUP_BYTES + 1
    first = saved(settled(anchors(docs.where("doc_id IS NOT NULL"), groups), groups))
    # Every document with something to compare or to remove; both uses of their texts share one shuffle.
    flagged = marked(docs, sieve(_documents(first)), [F.col("doc_id")], "touched")
    touched = _by_group(flagged.where("touched AND doc_id IS NOT NULL"), groups)
    second = known_names(named(touched, first.where(F.col("kind") == OPEN), groups), groups)
    ranges = first.where(F.col("kind") == RANGES).union(second)
    whole = flagged.where("NOT touched OR doc_id IS NULL").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return whole.union(without(touched, ranges))
