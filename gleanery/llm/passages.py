"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words each. A passage's features (shares of byte classes and of pairs of
coarse classes, and how its words repeat) go through a dense layer h = max(0, W x + b). Gated attention weighs the passages,
a_k = softmax(u . (tanh(V h_k) * sigmoid(G h_k))), and the score is the sigmoid of a linear function of the weighted sum of all h_k.
All weights are learned from the documents' labels alone, in numpy with Adam, on at most SAMPLE labelled documents outside the
held-out fold; of a longer one, PER_DOCUMENT passages chosen by a hash over the whole text are learned from. Scoring reads every passage of every text: sums of
e^attention and of e^attention h_k are carried from slice to slice, so that memory does not grow with a text.

Defined results: null and empty texts, and texts without words, are empty bags and get the sigmoid of the last layer's bias.
A null label is no label; a document with conflicting labels counts as bad; rows that share an id and a text get the same score (of
rows that share an id, one is learned from). Without labelled rows, every score is 0. Tables may be empty and have more columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.folds import remainder
from gleanery.llm.hashing import column_bytes, letters, mix, pieces, prefix_sums, slices, span_hashes
from gleanery.llm.shared import quoted

SAMPLE, PER_DOCUMENT, PASSAGE = 6_000, 32, 64
HIDDEN, GATES, EPOCHS, BATCH, RATE, DECAY = 24, 8, 30, 64, 0.01, 1e-4
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.5
#: Bytes whose features are counted at once.
SLICE = 1 << 18
_U = np.uint64


@lru_cache(1)
def classes() -> tuple[np.ndarray, int, np.ndarray, int]:
    """For every byte its class (each mark is one of its own) and its coarse class, and how many there are."""
    coarse = np.full(256, 6)  # marks
    coarse[97:123], coarse[65:91], coarse[48:58], coarse[128:] = 0, 1, 2, 3
    coarse[[0x20, 0x09]], coarse[0x0A:0x0E] = 4, 5
    coarse[[*b".,;:!?"]] = 7
    fine = coarse.copy()
    marks = np.flatnonzero(coarse >= 6)
    marks = marks[marks > 32]
    fine[marks] = np.arange(8, 8 + len(marks))
    return fine, 8 + len(marks), coarse, 8


def width() -> int:
    _, fine, _, coarse = classes()
    return fine + coarse * coarse + 4


def features(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages of the texts ``bounds`` of ``body``, and the text of each passage."""
    fine, n_fine, coarse, n_coarse = classes()
    values, blank = letters()
    inside = ~blank[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
    end = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    if not len(start):
        return np.zeros((0, width()), np.float32), np.zeros(0, np.int64)
    text = np.searchsorted(bounds, start, "right") - 1
    words_before = np.searchsorted(start, bounds)  # of each text
    opens = (np.arange(len(start)) - words_before[text]) % PASSAGE == 0
    passage = np.cumsum(opens) - 1  # of each word
    n, first = int(passage[-1]) + 1, np.flatnonzero(opens)
    # Bytes belong to the passage of the word before or around them; what stands before a text's first word counts nowhere.
    holder = np.cumsum(np.bincount(start, minlength=len(body))) - 1
    within = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    known = holder >= words_before[within]
    at = np.where(known, passage[np.maximum(holder, 0)], n)
    sizes = np.maximum(np.bincount(at, minlength=n + 1)[:n], 1)[:, None]
    ones = np.bincount(at * n_fine + fine[body], minlength=(n + 1) * n_fine)[:n * n_fine].reshape(n, n_fine) / sizes
    kind = coarse[body]
    pair = kind[:-1] * n_coarse + kind[1:]
    together = at[1:] == at[:-1]
    code = at[1:][together] * n_coarse ** 2 + pair[together]
    twos = np.bincount(code, minlength=(n + 1) * n_coarse ** 2)[:n * n_coarse ** 2].reshape(n, -1) / sizes
    words = np.diff(np.concatenate([first, [len(start)]]))
    hashes = span_hashes(prefix_sums(body, values), start, end)
    again = np.zeros(len(start), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & ~opens[1:]
    order = np.lexsort((hashes, passage))
    new = np.ones(len(start), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order][new], minlength=n)
    shape = np.stack([
        np.add.reduceat(again, first, dtype=np.int64) / words, distinct / words, words / PASSAGE,
        np.add.reduceat(end - start, first) / words / 16], axis=1)
    return np.concatenate([np.sqrt(ones), np.sqrt(twos), np.minimum(shape, 4)], axis=1).astype(np.float32), text[first]


def bags(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of passages and the row of each, some at a time; a long text comes in slices."""
    data, offsets = column_bytes(column)
    for first, last in slices(offsets, SLICE):
        body = data[offsets[first]:offsets[last]]
        if last - first > 1:
            made, rows = features(body, offsets[first:last + 1] - offsets[first])
            yield made, rows + first
        else:
            for piece in pieces(body, SLICE):
                made, _ = features(piece, np.array([0, len(piece)]))
                yield made, np.full(len(made), first)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """Encoder, gated attention and the last layer."""

    NAMES = ("w", "b", "v", "g", "u", "out", "bias")

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        random = np.random.default_rng(5)
        self.mean, self.spread = mean.astype(np.float32), spread.astype(np.float32)
        self.w = random.normal(0, (2 / len(mean)) ** 0.5, (len(mean), HIDDEN))
        self.b = np.zeros(HIDDEN)
        self.v = random.normal(0, HIDDEN ** -0.5, (HIDDEN, GATES))
        self.g = random.normal(0, HIDDEN ** -0.5, (HIDDEN, GATES))
        self.u = random.normal(0, GATES ** -0.5, GATES)
        self.out, self.bias = random.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Scaled features, h, both gates and the attention logits of passages."""
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.maximum(x @ self.w + self.b, 0)
        tanh, gate = np.tanh(h @ self.v), sigmoid(h @ self.g)
        return x, h, tanh, gate, (tanh * gate) @ self.u

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores of the bags ``bounds``, and what the gradient needs. The logits are bounded by the sum of |u|."""
        x, h, tanh, gate, logit = self.encoded(x)
        bag = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        e = np.exp(logit)
        weight = e / np.bincount(bag, e, len(bounds) - 1)[bag]
        z = np.zeros((len(bounds) - 1, HIDDEN))
        np.add.at(z, bag, weight[:, None] * h)
        return sigmoid(z @ self.out + self.bias), (x, h, tanh, gate, weight, bag, z)

    def gradient(self, x: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the bags."""
        score, (x, h, tanh, gate, weight, bag, z) = self.forward(x, bounds)
        error = (score - labels) / len(labels)
        pull = error[:, None] * self.out  # at z
        along = (h * pull[bag]).sum(axis=1)
        into = weight * (along - (z * pull).sum(axis=1)[bag])  # at the attention logits
        at_tanh = into[:, None] * self.u * gate * (1 - tanh ** 2)
        at_gate = into[:, None] * self.u * tanh * gate * (1 - gate)
        at_h = (weight[:, None] * pull[bag] + at_tanh @ self.v.T + at_gate @ self.g.T) * (h > 0)
        return {
            "w": x.T @ at_h, "b": at_h.sum(axis=0), "v": h.T @ at_tanh, "g": h.T @ at_gate,
            "u": (tanh * gate).T @ into, "out": z.T @ error, "bias": np.array([error.sum()])}

    def train(self, bags: list[np.ndarray], labels: np.ndarray) -> None:
        random = np.random.default_rng(6)
        first = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        second = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        step, steps = 0, EPOCHS * -(-len(bags) // BATCH)
        for _ in range(EPOCHS):
            order = random.permutation(len(bags))
            for begin in range(0, len(order), BATCH):
                chosen = order[begin:begin + BATCH]
                bounds = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])])
                slopes = self.gradient(np.concatenate([bags[i] for i in chosen]).astype(np.float32), bounds, labels[chosen])
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                for n in self.NAMES:
                    slope = slopes[n] + (DECAY * getattr(self, n) if n != "bias" else 0)
                    first[n] += 0.1 * (slope - first[n])
                    second[n] += 0.001 * (slope ** 2 - second[n])
                    move = first[n] / (1 - 0.9 ** step) / (np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8)
                    setattr(self, n, getattr(self, n) - rate * move)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, label and the features of PER_DOCUMENT passages at most of each of ``docs`` (doc_id, label, text)."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("bag", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(batch.num_rows)]
            seen = np.zeros(batch.num_rows, np.int64)
            for made, rows in bags(batch.column(2)):
                begins = np.flatnonzero(np.concatenate([[True], np.diff(rows) > 0])) if len(rows) else []
                for a, b in zip(begins, [*begins[1:], len(rows)], strict=True):
                    row = int(rows[a])
                    order = mix(np.arange(seen[row], seen[row] + b - a, dtype=_U) + _U(1))
                    seen[row] += b - a
                    held[row].append((order, made[a:b]))
                    order, part = (np.concatenate(c) for c in zip(*held[row], strict=True))
                    best = np.argsort(order, kind="stable")[:PER_DOCUMENT]
                    held[row] = [(order[best], part[best])]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.array([h[0][1].astype("<f2").tobytes() if h else b"" for h in held], pa.binary())], names=schema.names)

    return docs.select("doc_id", "label", "text").mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Attention | None:
    """A model of the labelled documents outside the held-out fold, or None without any."""
    known = labels.where(quoted(quality).isNotNull() & (remainder(quoted(doc_id), FOLDS) != HELD_OUT))
    known = known.groupBy(quoted(doc_id).alias("doc_id")).agg(F.min(quoted(quality)).alias("label"))
    known = known.select("doc_id", (F.col("label") > 0).cast("int").alias("label"), F.xxhash64(F.lit("bags"), "doc_id").alias("at"))
    share = min(1.0, 2 * SAMPLE / max(known.count(), 1))  # few rows reach the driver, however many tasks there are
    chosen = known.where(F.col("at") <= F.lit(min(int(share * 2 ** 64) - 2 ** 63, 2 ** 63 - 1))).orderBy("at", "doc_id").limit(SAMPLE)
    texts = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    texts = texts.join(F.broadcast(chosen.select("doc_id", "label")), "doc_id")  # SAMPLE rows of two numbers
    rows = packed(texts).groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("bag"), "label", "bag")).alias("one"))
    found = sorted(((r[0], r[1]["label"], r[1]["bag"]) for r in rows.collect()), key=lambda r: (r[2], r[1]))
    if not found:
        return None
    sets = [np.frombuffer(r[2], "<f2").reshape(-1, width()) for r in found]
    targets = np.array([float(r[1]) for r in found])
    count = max(sum(len(s) for s in sets), 1)
    mean = sum(s.sum(axis=0, dtype=np.float64) for s in sets) / count
    spread = np.sqrt(np.maximum(sum((s.astype(np.float64) ** 2).sum(axis=0) for s in sets) / count - mean ** 2, 0)) + 0.02
    model = Attention(mean, spread)
    model.train(sets, targets)
    return model


def scored(docs: DataFrame, model: Attention | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            if known is not None:
                total, linear = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                for made, at in bags(batch.column(1)):
                    _, h, _, _, logit = known.encoded(made)
                    e = np.exp(logit)
                    total += np.bincount(at, e, batch.num_rows)
                    linear += np.bincount(at, e * (h @ known.out), batch.num_rows)
                scores = sigmoid(linear / np.where(total > 0, total, 1) + known.bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(
        "doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
