"""Repeated passages where rows share an id but not a text."""

import hashlib
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import numpy as np

from gleanery.llm import repeats


def two_byte(text):
    return hashlib.blake2b(text.encode(), digest_size=2).digest()


def test_texts_of_one_id_whose_short_checksums_agree(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(200))
    copy = passage + " tail"
    n = 0
    while two_byte(other := f"{n} " + "".join(random.Random(n).choice("ijklmnop ") for _ in range(230))) != two_byte(copy):
        n += 1
    rows = [(1, passage), (2, copy), (2, other)]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in repeats.removed_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 200): 0, (2, len(copy)): 200, (2, len(other)): 0}


def test_packed_rows_come_back():
    rng = np.random.default_rng(2)
    for texts in (1, 5, 70_000):
        n = 80_000
        pick = rng.integers(0, texts, n)
        rows = {
            "doc": rng.integers(-9, 9, texts)[pick], "tag": rng.integers(-2 ** 62, 2 ** 62, texts)[pick],
            "lo": rng.integers(0, 2 ** 32, n), "hi": rng.integers(0, 2 ** 32, n)}
        back = repeats.unpack(iter([repeats.pack(rows, repeats.RANGE)] * 2), repeats.RANGE)
        assert all(np.array_equal(back[k], np.concatenate([rows[k]] * 2)) for k in rows)
