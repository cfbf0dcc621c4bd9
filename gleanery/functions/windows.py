"""Which parts of texts may be among many names: hashes of all windows against a bitmap of fixed size.

A window is a run of bytes as long as some name. The bitmap never misses a name and may let other windows pass, so
that what is found here is compared with the names by an ordinary join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a bitmap for each name, and the sizes (powers of two) of the smallest and of the largest one, of 32 MB.
BITS_A_NAME, LEAST_BITS, MOST_BITS = 32, 15, 28
#: Rows whose windows are hashed together, and bits of one of Spark's bitmaps.
ROWS_AT_ONCE, CELL = 500, 32768
_MULTIPLIER, _MIX = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD6E8FEB86659FD93)


def hashes(columns: Iterable[np.ndarray], n: int) -> np.ndarray:
    """64-bit hashes of ``n`` strings of one length, given byte by byte."""
    out = np.zeros(n, np.uint64)
    for column in columns:
        out *= _MULTIPLIER
        out += column
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return (out ^ (out >> np.uint64(29))) * _MIX


def spots(names: Column, bits: int) -> Column:
    """The place of each name in a bitmap of 2^bits."""

    @F.arrow_udf(T.LongType())
    def places(column: pa.Array) -> pa.Array:
        bodies = [name.encode() for name in column.to_pylist()]
        sizes = np.array([len(b) for b in bodies], np.int64)
        out = np.zeros(len(bodies), np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            table = np.frombuffer(b"".join(bodies[i] for i in at), np.uint8).reshape(len(at), size)
            out[at] = (hashes(table.T, len(at)) >> np.uint64(64 - bits)).astype(np.int64)
        return pa.array(out)

    return places(names)


def bitmap(names: DataFrame, name: str) -> tuple[int, list[int], Broadcast]:
    """Bits, the lengths in bytes of all names, and the bitmap: 2^MOST_BITS bits at most, however many names there are."""
    lengths = names.groupBy(F.octet_length(name).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
    bits = min(max((BITS_A_NAME * sum(r.n for r in lengths)).bit_length(), LEAST_BITS), MOST_BITS)
    # Spark counts places from 1.
    cells = names.select((spots(F.col(name), bits) + 1).alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("cell")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for row in cells.toLocalIterator():
        begin = (row.cell - 1) * CELL // 8
        whole[begin:begin + CELL // 8] = np.frombuffer(row.bits, np.uint8)
    return bits, sorted(r.size for r in lengths), names.sparkSession.sparkContext.broadcast(whole)


def windows(text: Column, known: tuple[int, list[int], Broadcast]) -> Column:
    """The distinct windows of a text that pass the bitmap, in UTF-8."""
    bits, lengths, shared = known

    def passing(bodies: list[bytes]) -> list[set[bytes]]:
        found: list[set[bytes]] = [set() for _ in bodies]
        whole, ends = b"".join(bodies), np.cumsum([len(b) for b in bodies])
        data, longest = np.frombuffer(whole, np.uint8), max(map(len, bodies))
        for size in lengths:
            if size > longest:
                break
            n = len(data) - size + 1
            spot = hashes((data[k:k + n] for k in range(size)), n) >> np.uint64(64 - bits)
            begins = np.flatnonzero(shared.value[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8) & 1) if size else np.zeros(0, np.int64)
            rows = np.searchsorted(ends, begins, "right")
            inside = begins + size <= ends[rows] if len(rows) else np.zeros(0, bool)
            for begin, row in zip(begins[inside].tolist(), rows[inside].tolist()):
                found[row].add(whole[begin:begin + size])
        for row in found if 0 in lengths else ():
            row.add(b"")
        return found

    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            out = []
            for begin in range(0, len(column), ROWS_AT_ONCE):
                out += passing([t.encode() for t in column.slice(begin, ROWS_AT_ONCE).to_pylist()])
            yield pa.array([list(row) for row in out], pa.list_(pa.binary()))

    return of(text)
