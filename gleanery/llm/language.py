"""Language identification by a convolutional network over bytes.

A whole text is cut into windows of WINDOW bytes. Bytes are embedded, filters of several widths slide over
a window, the maximum of each filter over the window is kept, and a softmax gives the languages'
probabilities; a text's probability is the mean over its windows, weighted by their bytes. The network is trained in numpy
with Adam on at most SAMPLE labelled rows outside the held-out fold, two windows of each.

Defined results: ``und`` with score 0 for null texts, for texts without a letter, and where nothing was
learned. Null languages are no labels. Rows that share an id and a text get the same answer. Tables may be
empty and have more columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.folds import remainder, sample
from gleanery.llm.hashing import column_bytes
from gleanery.llm.shared import quoted

SAMPLE, WINDOW = 4000, 256
WIDTHS, FILTERS, DIMS = (2, 3, 4), 8, 6
EPOCHS, BATCH, RATE = 4, 64, 0.01
#: Windows that are convolved at once.
AT_ONCE = 64
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"


class Network:
    """Embedding, filters (narrow ones padded with zeros to the widest), dense layer."""

    def __init__(self, languages: list[str]):
        random = np.random.default_rng(3)
        widest, count = max(WIDTHS), FILTERS * len(WIDTHS)
        self.languages = languages
        self.embed = random.normal(0, 0.5, (256, DIMS)).astype(np.float32)
        self.embed[0] = 0
        self.mask = np.zeros((widest, DIMS, count), np.float32)
        for i, width in enumerate(WIDTHS):
            self.mask[:width, :, i * FILTERS:(i + 1) * FILTERS] = 1
        self.filters = (random.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.dense = random.normal(0, 0.3, (count, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        widest = max(WIDTHS)
        padded = np.zeros((len(windows), windows.shape[1] + widest - 1), np.uint8)
        padded[:, :windows.shape[1]] = windows
        bytes_at = sliding_window_view(padded, widest, axis=1)
        inputs = self.embed[padded]
        columns = sliding_window_view(inputs, (widest, DIMS), axis=(1, 2))[:, :, 0].reshape(-1, widest * DIMS)
        out = columns @ self.filters.reshape(widest * DIMS, -1)
        out = out.reshape(len(windows), windows.shape[1], -1)
        return out, columns, bytes_at

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for begin in range(0, len(windows), AT_ONCE):
            out, _, _ = self.pooled(windows[begin:begin + AT_ONCE])
            logit = np.maximum(out.max(axis=1), 0) @ self.dense + self.bias
            e = np.exp(logit - logit.max(axis=1, keepdims=True))
            parts.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(parts)

    def train(self, windows: np.ndarray, labels: np.ndarray) -> None:
        random = np.random.default_rng(4)
        names = ("embed", "filters", "dense", "bias")
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        step = 0
        for _ in range(EPOCHS):
            order = random.permutation(len(windows))
            for begin in range(0, len(order), BATCH):
                chosen = order[begin:begin + BATCH]
                out, columns, bytes_at = self.pooled(windows[chosen])
                top = out.argmax(axis=1)
                best = np.take_along_axis(out, top[:, None], axis=1)[:, 0]
                hidden = np.maximum(best, 0)
                logit = hidden @ self.dense + self.bias
                e = np.exp(logit - logit.max(axis=1, keepdims=True))
                error = e / e.sum(axis=1, keepdims=True)
                error[np.arange(len(chosen)), labels[chosen]] -= 1
                error /= len(chosen)
                back = (error @ self.dense.T) * (best > 0)
                columns = columns.reshape(len(chosen), windows.shape[1], -1)
                seen = columns[np.arange(len(chosen))[:, None], top]  # window, filter, widest * DIMS
                slopes = {
                    "dense": hidden.T @ error, "bias": error.sum(axis=0),
                    "filters": np.einsum("nf,nfk->kf", back, seen).reshape(self.filters.shape) * self.mask,
                }
                pull = np.einsum("nf,kdf->nfkd", back, self.filters)
                places = bytes_at[np.arange(len(chosen))[:, None], top]
                slope = np.zeros_like(self.embed)
                np.add.at(slope, places.ravel(), pull.reshape(-1, DIMS))
                slope[0] = 0
                slopes["embed"] = slope
                step += 1
                for n in names:
                    first[n] += 0.1 * (slopes[n] - first[n])
                    second[n] += 0.001 * (slopes[n] ** 2 - second[n])
                    move = first[n] / (1 - 0.9 ** step) / (np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8)
                    setattr(self, n, (getattr(self, n) - RATE * move).astype(np.float32))


def windows_of(data: np.ndarray) -> np.ndarray:
    """All of ``data`` as rows of WINDOW bytes, the last one padded with zeros."""
    rows = -(-len(data) // WINDOW)
    out = np.zeros(rows * WINDOW, np.uint8)
    out[:len(data)] = data
    return out.reshape(rows, WINDOW)


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network trained on labelled rows outside the held-out fold, or None without any."""
    allowed = quoted(lang).isNotNull() & quoted(text).isNotNull() & (remainder(quoted(doc_id), FOLDS) != HELD_OUT)
    middle = F.greatest(F.lit(1), (F.length(quoted(text)) / 2).cast("int"))
    excerpt = F.concat(F.substring(quoted(text), 1, WINDOW), F.lit("\n"), quoted(text).substr(middle, F.lit(WINDOW)))
    rows = sample(docs.where(allowed).select(
        quoted(doc_id).alias("doc_id"), quoted(lang).cast("string").alias("lang"), excerpt.alias("excerpt")), "doc_id", SAMPLE).collect()
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    windows, labels = [], []
    for r in rows:
        cut = windows_of(np.frombuffer(r["excerpt"].encode(), np.uint8))
        windows.append(cut)
        labels += [languages.index(r["lang"])] * len(cut)
    network = Network(languages)
    network.train(np.concatenate(windows), np.array(labels))
    return network


def identified(docs: DataFrame, network: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    rows = docs.select(
        quoted(doc_id).alias("doc_id"), F.coalesce(quoted(text).rlike(r"\p{L}"), F.lit(False)).alias("known"), quoted(text).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            known = batch.column(1).to_numpy(zero_copy_only=False) & (model is not None)
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            data, offsets = column_bytes(batch.column(2))
            at = 0
            while at < batch.num_rows:  # rows are convolved together until they fill a few blocks
                stop, total = at, 0
                while stop < batch.num_rows and total < AT_ONCE * WINDOW * 4:
                    total += int(offsets[stop + 1] - offsets[stop])
                    stop += 1
                chosen = [i for i in range(at, stop) if known[i]]
                sums = {i: 0.0 for i in chosen}
                pending: list[tuple[int, np.ndarray]] = []
                for i in chosen:
                    body = data[offsets[i]:offsets[i + 1]]
                    step = AT_ONCE * WINDOW * 4
                    pending += [(i, body[s:s + step]) for s in range(0, len(body), step)]
                while pending:
                    part, size = [], 0
                    while pending and size < AT_ONCE * WINDOW * 4:
                        part.append(pending.pop(0))
                        size += len(part[-1][1])
                    cut = [windows_of(b) for _, b in part]
                    found = model.probabilities(np.concatenate(cut))
                    begin = 0
                    for (i, body), windows in zip(part, cut, strict=True):
                        weight = np.full(len(windows), float(WINDOW))
                        weight[-1] = len(body) - WINDOW * (len(windows) - 1)
                        sums[i] = sums[i] + weight @ found[begin:begin + len(windows)]
                        begin += len(windows)
                for i in chosen:
                    mean = sums[i] / (offsets[i + 1] - offsets[i])
                    names[i], scores[i] = model.languages[int(mean.argmax())], min(1.0, float(mean.max()))
                at = stop
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    return rows.mapInArrow(run, schema).select(
        "doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
