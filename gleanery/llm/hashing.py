"""Word hashes of whole batches of texts with numpy: no loop over characters or words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; bounds a worker's memory, not what is read.
SLICE_BYTES = 1 << 18
#: Bytes of the word beginnings that count as terms too.
PREFIXES = (4, 5, 6)
_U = np.uint64
_MULTIPLIER = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def random_table(seed: int, size: int) -> np.ndarray:
    return mix(np.arange(1, size + 1, dtype=_U) * _MULTIPLIER + _U(seed)) | _U(1)


@lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """A random value for each byte, A-Z as a-z, and which bytes end words."""
    values = random_table(7, 256)
    values[65:91] = values[97:123]
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    return values, blank


_powers = (np.ones(1, _U), np.ones(1, _U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number modulo 2^64, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        base = 0x5851F42D4C957F2D
        size = 1 << (n - 1).bit_length()
        made = []
        for x in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, x, _U)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        _powers = (made[0], made[1])
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of values[data[k]] * M^k for i <= k < j."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(values[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end): equal spans hash equally wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(_U))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (nulls are empty), without copying texts."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return body, at


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [first, last) of about ``limit`` bytes; a longer text is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def pieces(data: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[np.ndarray]:
    """A long text in pieces that end behind white space (a longer word stays whole)."""
    _, blank = letters()
    start = 0
    while start < len(data):
        end = min(start + limit, len(data))
        while end < len(data):
            found = np.flatnonzero(blank[data[start:end]])
            if len(found):
                end = start + int(found[-1]) + 1
                break
            end = min(end + limit, len(data))
        yield data[start:end]
        start = end


@lru_cache(1)
def no_letters() -> np.ndarray:
    """Bytes that end a term: ASCII but letters and digits."""
    out = np.arange(256) < 128
    out[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, terms: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of the rows ``offsets`` (relative to ``data``), in order.

    With ``terms``, words are runs of letters and digits, and the beginnings of longer words follow them.
    """
    values, blank = letters()
    blank = no_letters() if terms else blank
    inside = ~blank[data]
    row_start = np.zeros(len(data) + 1, bool)
    row_start[offsets] = True
    starts = inside.copy()
    starts[1:] &= blank[data[:-1]] | row_start[1:-1]
    ends = inside.copy()
    ends[:-1] &= blank[data[1:]] | row_start[1:-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums, rows = prefix_sums(data, values), np.searchsorted(offsets, start, "right") - 1
    if not terms:
        return span_hashes(sums, start, end), rows
    found = [(span_hashes(sums, start, end), rows)]
    for size in PREFIXES:  # stems: the words that share a beginning
        longer = end - start > size
        found.append((span_hashes(sums, start[longer], start[longer] + size), rows[longer]))
    return np.concatenate([h for h, _ in found]), np.concatenate([r for _, r in found])


def batch_words(column: pa.Array, terms: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows of a string column: first, last, the hashes of all words, the row of each (from 0)."""
    data, offsets = column_bytes(column)
    for first, last in slices(offsets):
        body = data[offsets[first]:offsets[last]]
        if len(body) <= 2 * SLICE_BYTES:
            hashes, rows = word_hashes(body, offsets[first:last + 1] - offsets[first], terms)
        else:  # one very long text
            hashes = np.concatenate([word_hashes(p, np.array([0, len(p)]), terms)[0] for p in pieces(body)])
            rows = np.zeros(len(hashes), np.int64)
        yield first, last, hashes, rows
