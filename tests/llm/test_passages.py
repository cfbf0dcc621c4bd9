"""The quality model: gradient, streaming of long texts, held-out accuracy, odd rows."""

import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gleanery.llm import passages

SCHEMA = "doc_id long, text string, lang string, score double, label int, bag string"


def bag_of(text):
    """Features of all passages of a text, passage by passage and byte by byte."""
    fine, n_fine, coarse, n_coarse = passages.classes()
    body = text.encode()
    words, at = [], None
    for i, byte in enumerate(body):
        blank = byte == 0x20 or 0x09 <= byte <= 0x0D
        if not blank and at is None:
            at = i
        if blank and at is not None:
            words.append((at, i))
            at = None
    if at is not None:
        words.append((at, len(body)))
    out = []
    for first in range(0, len(words), passages.PASSAGE):
        mine = words[first:first + passages.PASSAGE]
        end = words[first + passages.PASSAGE][0] if first + passages.PASSAGE < len(words) else len(body)
        part = body[mine[0][0]:end]
        ones, twos = np.zeros(n_fine), np.zeros(n_coarse ** 2)
        for byte in part:
            ones[fine[byte]] += 1
        for a, b in zip(part, part[1:]):
            twos[coarse[a] * n_coarse + coarse[b]] += 1
        names = [bytes(c + 32 if 65 <= c <= 90 else c for c in body[a:b]) for a, b in mine]
        again = sum(a == b for a, b in zip(names, names[1:]))
        shape = [again / len(mine), len(set(names)) / len(mine), len(mine) / passages.PASSAGE, sum(b - a for a, b in mine) / len(mine) / 16]
        out.append(np.concatenate([np.sqrt(ones / len(part)), np.sqrt(twos / len(part)), np.minimum(shape, 4)]))
    return np.array(out).reshape(-1, passages.width())


def test_features_of_whole_texts(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "Bb", "c,", "dé.", "#$", "e\n", "12"]) for _ in range(n)) for n in (1, 63, 64, 65, 300, 7)]
    texts = [texts[0], None, *texts[1:], "", " \n ", "  lead", "x" * 5000]
    made = list(passages.bags(pa.array(texts)))
    rows = np.concatenate([r for _, r in made])
    for i, text in enumerate(texts):
        np.testing.assert_allclose(np.concatenate([m for m, _ in made])[rows == i], bag_of(text or ""), atol=1e-6)


def test_gradient():
    random_ = np.random.default_rng(1)
    x = random_.normal(size=(9, passages.width()))
    bounds, labels = np.array([0, 2, 2, 5, 9]), np.array([1.0, 0.0, 0.0, 1.0])
    model = passages.Attention(np.zeros(passages.width()), np.ones(passages.width()))
    slopes = model.gradient(x, bounds, labels)

    def loss():
        score, _ = model.forward(x, bounds)
        return -np.mean(labels * np.log(score) + (1 - labels) * np.log(1 - score))

    for name in model.NAMES:
        weights = getattr(model, name)
        for _ in range(5):
            at = tuple(random_.integers(0, d) for d in weights.shape)
            was = weights[at]
            weights[at] = was + 1e-5
            above = loss()
            weights[at] = was - 1e-5
            below = loss()
            weights[at] = was
            assert slopes[name][at] == pytest.approx((above - below) / 2e-5, abs=1e-7)


def texts_of(n):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(60, 500))]
        bad = i % 3 == 0
        if bad:  # only one stretch of the text is bad: an average would hide it
            at = rng.randrange(max(1, len(words) - 64))
            words[at:at + 64] = [w + " |" for w in words[at:at + 64]]
        yield i, " ".join(words), int(not bad)


@pytest.fixture(scope="module")
def learned(spark):
    rows = list(texts_of(900))
    docs = spark.createDataFrame([(i, t, None, 0.1, 3, "b") for i, t, _ in rows], SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, q, "x") for i, _, q in rows] + [(5, None, "x"), (99999, 1, "x")], "doc_id long, quality int, text string")
    return rows, docs, passages.learn(docs, labels)


def test_held_out_accuracy(spark, learned):
    rows, docs, model = learned
    got = {r.doc_id: r for r in passages.scored(docs, model).collect()}
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(got[i].predicted == q for i, q in held) >= 0.95 * len(held)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_scores_are_the_forward_pass(spark, learned):
    rows, _, model = learned
    long = " ".join(t for _, t, _ in rows)  # several slices
    texts = [rows[0][1], None, "", " \n", long, rows[0][1], "word"]
    docs = spark.createDataFrame([(i, t, None, 0.1, 3, "b") for i, t in enumerate(texts)] + [(None, "of no id", "en", 1.0, 1, "b")], SCHEMA)
    got = {r.doc_id: r.score for r in passages.scored(docs, model).collect()}
    assert len(long) > 3 * passages.SLICE
    for i, text in enumerate(texts):
        made = [m for m, _ in passages.bags(pa.array([text], pa.string()))]
        bag = np.concatenate([np.zeros((0, passages.width())), *made])
        assert got[i] == pytest.approx(float(model.forward(bag, np.array([0, len(bag)]))[0][0]), abs=1e-9)
    assert got[1] == got[2] == got[3] == pytest.approx(float(passages.sigmoid(model.bias)[0]))
    assert got[0] == got[5]


def test_labels_only_count_outside_the_fold(spark, learned):
    rows, docs, _ = learned
    held = [(i, 1 - q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [(i, q) for i, _, q in rows]
    learn = lambda pairs: passages.learn(docs, spark.createDataFrame(pairs, "doc_id long, quality int"))
    a = learn(right)
    b = learn([p for p in right if zlib.crc32(str(p[0]).encode()) % 3 != 1] + held)
    assert all(np.array_equal(getattr(a, n), getattr(b, n)) for n in a.NAMES)


def test_without_labels_or_rows(spark, learned):
    _, docs, model = learned
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert passages.learn(docs, none) is None
    assert {r.score for r in passages.scored(docs, None).collect()} == {0.0}
    empty = spark.createDataFrame([], SCHEMA)
    assert passages.scored(empty, model).count() == 0
    assert passages.learn(empty, none) is None
    conflicting = spark.createDataFrame([(0, 1), (0, 0), (2, 1)], "doc_id long, quality int")
    assert passages.learn(docs, conflicting) is not None
