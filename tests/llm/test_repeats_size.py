"""What a packed anchor costs on disk."""

import zlib

import numpy as np

from gleanery.llm import repeats


def test_packed_rows_are_small_and_whole():
    rng = np.random.default_rng(5)
    for n, texts in ((0, 1), (1, 1), (9, 9), (300, 230)):
        doc = np.sort(rng.integers(0, texts, n)) * 997 + 100_000
        rows = {"doc": doc, "tag": np.zeros(n, np.int64), "h": rng.integers(0, 1 << 32, n), "c": rng.integers(0, 1 << 32, n),
                "d": rng.integers(0, 1 << 16, n), "lo": rng.integers(0, 5000, n), "n": rng.integers(0, 31, n)}
        body = repeats.pack(rows, repeats.ANCHOR)
        back = repeats.unpack(iter([body]), repeats.ANCHOR)
        names = ("doc", "tag", "lo", "h", "c", "d", "n")
        assert all(back[k].tolist() == rows[k].tolist() for k in names)
    # 11 bytes of names and lengths; the place in the text and the text itself are the rest (17.6 bytes before).
    assert len(zlib.compress(body, 1)) / 300 < 16
