"""Toxicity scores by a factorization machine over hashed terms.

A text is the set of its terms (runs of letters and digits, A-Z lower-cased, and their first 4, 5 and 6 bytes),
hashed to 2^22 buckets. A term's value x_i is between 0 (in every training row) and 1 (rare, or in a telling pair). The machine
scores w0 + sum of w_i x_i + sum over pairs of <v_i, v_j> x_i x_j; the pair term learns interactions, such as
an insult with the mention of a group, that additive weights miss. It is trained in numpy with Adagrad on
at most SAMPLE labelled rows and applied to whole texts in Arrow batches. Of the buckets that MIN_DOCS of these rows have,
the machine gets those that tell the label by themselves (|z| >= MIN_Z, TERMS at most) and both members of every
pair that tells it: all pairs of the TERMS most frequent buckets are counted, and held against what a machine
without them expects of the same rows. A member need not tell anything alone. All other buckets are noise to
the machine; with them, it learns its sample by heart. The model is a fixed-size table, whatever the data.

Defined results: null and empty texts get the score of an empty set; a null label is no label; rows that
share an id and a text get the same score. Without labelled rows, every score is 0. Documents with
conflicting labels count as toxic. Tables may be empty and have more columns.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.folds import remainder, sample
from gleanery.llm.hashing import batch_words, slices
from gleanery.llm.shared import quoted

SAMPLE, TERMS, MIN_DOCS, MIN_Z, BUCKET_BITS = 10_000, 1 << 14, 6, 4.0, 22
#: The chance that any pair of a sample without interactions passes.
PAIR_ERROR = 0.05
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 20, 128, 0.2, 1e-5
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Pairs, and rows, that training looks at together; bounds its memory, not what it counts.
PAIRS_AT_ONCE, ROWS_AT_ONCE = 1 << 19, 500


def term_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, all rows' sorted distinct buckets, and the bounds of each row's share."""
    for first, last, words, rows in batch_words(column, terms=True):
        buckets = (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        both = np.unique(rows << BUCKET_BITS | buckets)
        bounds = np.searchsorted(both, np.arange(last - first + 1) << BUCKET_BITS)
        yield first, both & ((1 << BUCKET_BITS) - 1), bounds


def terms(docs: DataFrame) -> DataFrame:
    """``docs`` has text and label: label and the buckets of the text, as packed 32-bit integers."""
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("terms", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buckets, bounds in term_sets(batch.column(1)):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(bounds) - 1),
                    pa.array([buckets[a:b].astype("<i4").tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                ], names=schema.names)

    return docs.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(run, schema)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i]:bounds[i + 1]]`` (empty segments give 0)."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), np.float64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values, bounds[:-1][some], axis=0, dtype=np.float64)
    return out


class Machine:
    """w0, and for each kept bucket a weight and a vector."""

    def __init__(self, buckets: np.ndarray, values: np.ndarray):
        self.buckets, self.values, self.bias = buckets, values.astype(np.float32), 0.0
        random = np.random.default_rng(1)
        self.weights = np.zeros(len(buckets), np.float32)
        self.vectors = random.normal(0, 0.01, (len(buckets), FACTORS)).astype(np.float32)

    def known(self, buckets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the kept buckets among ``buckets``, and the bounds of the rows' shares."""
        at = np.searchsorted(self.buckets, buckets)
        hit = at < len(self.buckets)
        hit[hit] = self.buckets[at[hit]] == buckets[hit]
        return at[hit].astype(np.int32), np.concatenate([[0], np.cumsum(hit)])[bounds]

    def logits(self, at: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = self.values[at]
        vectors = self.vectors[at] * values[:, None]
        sums = segment_sums(vectors, bounds)
        pairs = (sums ** 2).sum(axis=1) - segment_sums((vectors ** 2).sum(axis=1), bounds)
        return self.bias + segment_sums(self.weights[at] * values, bounds) + pairs / 2, sums

    def train(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        random = np.random.default_rng(2)
        seen_w, seen_v, seen_b = np.full(len(self.weights), 1e-6), np.full(self.vectors.shape, 1e-6), 1e-6
        rate = labels.mean()
        self.bias = float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
        for _ in range(EPOCHS):
            order = random.permutation(len(rows))
            for begin in range(0, len(order), BATCH):
                chosen = order[begin:begin + BATCH]
                sizes = np.array([len(rows[i]) for i in chosen])
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                at = np.concatenate([rows[i] for i in chosen]) if bounds[-1] else np.zeros(0, np.int64)
                logit, sums = self.logits(at, bounds)
                error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[chosen]
                values = self.values[at]
                share = np.repeat(error, sizes) * values / len(chosen)
                touched, where = np.unique(at, return_inverse=True)
                slope_w = np.bincount(where, share, len(touched)) + DECAY * self.weights[touched]
                pull = (np.repeat(sums, sizes, axis=0) - self.vectors[at] * values[:, None]) * share[:, None]
                slope_v = np.stack([np.bincount(where, pull[:, f], len(touched)) for f in range(FACTORS)], axis=1)
                slope_v = slope_v + DECAY * self.vectors[touched]  # no terms at all give integers
                seen_w[touched] += slope_w ** 2
                seen_v[touched] += slope_v ** 2
                self.weights[touched] -= (RATE * slope_w / np.sqrt(seen_w[touched])).astype(np.float32)
                self.vectors[touched] -= (RATE / 4 * slope_v / np.sqrt(seen_v[touched])).astype(np.float32)
                slope_b = error.mean()
                seen_b += slope_b ** 2
                self.bias -= float(RATE * slope_b / np.sqrt(seen_b))


def trained(kept: np.ndarray, docs_with: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, paired: np.ndarray | None = None) -> Machine:
    """A machine of the buckets ``kept``, which ``docs_with`` of the ``sets`` have; those ``paired`` count in full."""
    values = np.log(len(sets) / docs_with) / np.log(max(len(sets), 2))
    machine = Machine(kept, values if paired is None else np.where(np.isin(kept, paired), 1.0, values))
    machine.train([machine.known(s, np.array([0, len(s)]))[0] for s in sets], labels)
    return machine


def expected(kept: np.ndarray, docs_with: np.ndarray, sets: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The chance of each row to be toxic, by a machine of ``kept`` trained on the other half of the rows."""
    out = np.full(len(sets), labels.mean())
    halves = [np.arange(i, len(sets), 2) for i in range(2)]
    for mine, other in (halves, halves[::-1]) if len(sets) > 1 else ():
        machine = trained(kept, docs_with, [sets[i] for i in other], labels[other])
        for part in np.split(mine, range(ROWS_AT_ONCE, len(mine), ROWS_AT_ONCE)):
            bounds = np.concatenate([[0], np.cumsum([len(sets[i]) for i in part])])
            logit, _ = machine.logits(*machine.known(np.concatenate([sets[i] for i in part]), bounds))
            out[part] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return out


def in_telling_pairs(columns: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Those of the sorted buckets ``columns`` in a pair whose rows are toxic far more, or less, often than ``chances`` say.

    Every pair that MIN_DOCS rows share is counted. It passes if Chernoff's bound of its count, times the number of
    pairs, is at most PAIR_ERROR. Buckets of the very same rows are counted as one.
    """
    known = Machine(columns, np.ones(len(columns)))
    rows = [known.known(s, np.array([0, len(s)]))[0] for s in sets]
    sign = np.zeros(len(columns))
    for row, value in zip(rows, np.random.default_rng(3).random(len(rows)), strict=True):
        sign[row] += value
    _, first, twin = np.unique(sign, return_index=True, return_inverse=True)
    leads = np.zeros(len(columns), bool)
    leads[first] = True
    place = (np.cumsum(leads) - 1).astype(np.int32)
    rows = [place[r[leads[r]]] for r in rows]
    ends = np.cumsum([len(r) for r in rows])
    # Rows, toxic rows and 1024 times the chances, in 14, 14 and 24 bits of one double (SAMPLE < 2^14).
    tally = 1.0 + labels * 2.0 ** 14 + np.clip(np.rint(chances * 1024), 10, 1014) * 2.0 ** 28
    telling = telling_leads(np.concatenate(rows), ends, tally, len(first))
    return columns[telling[place[first][twin]]]


def telling_leads(flat: np.ndarray, ends: np.ndarray, tally: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` members are in a telling pair. ``flat`` has the sets one after the other, each in order; each ends at ``ends``."""
    limit = np.log(max(n * (n - 1) / 2, 1) / PAIR_ERROR)
    telling = np.zeros(n, bool)
    entries = np.argsort(flat, kind="stable").astype(np.int32)
    for i, at in enumerate(np.split(entries, np.cumsum(np.bincount(flat, minlength=n))[:-1])):
        row = np.searchsorted(ends, at, "right")
        counts = ends[row] - at - 1  # the row's entries behind this one
        offsets = np.concatenate([[0], np.cumsum(counts)])
        if not offsets[-1]:
            continue
        sums = np.zeros(n - i)
        for a, b in slices(offsets, PAIRS_AT_ONCE):
            share = counts[a:b]
            places = np.repeat(at[a:b] + 1 - offsets[a:b], share) + np.arange(offsets[a], offsets[b])
            sums += np.bincount(flat[places] - i, np.repeat(tally[row[a:b]], share), n - i)
        sums = sums.astype(np.int64)
        shared, toxic, hope = sums & 16383, sums >> 14 & 16383, (sums >> 28) / 1024
        # The bound's exponent is at most this square, so that few pairs need it.
        some = np.flatnonzero((shared >= MIN_DOCS) & ((toxic - hope) ** 2 >= limit * hope * (1 - hope / np.maximum(shared, 1))))
        fraction, chance = toxic[some] / shared[some], hope[some] / shared[some]
        exponent = shared[some] * (fraction * np.log(np.maximum(fraction, 1e-300) / chance)
                                   + (1 - fraction) * np.log(np.maximum(1 - fraction, 1e-300) / (1 - chance)))
        passed = some[exponent >= limit]
        telling[passed + i] = True
        telling[i] |= len(passed) > 0
    return telling


def bucket_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many of the sets have each bucket, some sets at a time: no copy of the counts is made."""
    counts = np.zeros(1 << BUCKET_BITS, np.int32)
    for begin in range(0, len(sets), ROWS_AT_ONCE):
        found, times = np.unique(np.concatenate(sets[begin:begin + ROWS_AT_ONCE]), return_counts=True)
        counts[found] += times.astype(np.int32)
    return counts


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Machine | None:
    """A machine trained on the labelled rows outside the held-out fold, or None without any."""
    known = labels.where(quoted(toxic).isNotNull() & (remainder(quoted(doc_id), FOLDS) != HELD_OUT))
    known = known.groupBy(quoted(doc_id).alias("doc_id")).agg(F.max(quoted(toxic)).alias("label"))
    chosen = F.broadcast(sample(known, "doc_id", SAMPLE))  # SAMPLE rows of two numbers
    texts = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text")).join(chosen, "doc_id")
    rows = sample(terms(texts.select("label", "text")).withColumn("at", F.xxhash64("terms")), "at", SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, toxic_rows = [], []
        for batch in batches:
            toxic_rows += [float(label > 0) for label in batch.column(0).to_pylist()]
            sets += [np.frombuffer(body, "<i4") for body in batch.column(1).to_pylist()]
        if sets:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted(sets, np.array(toxic_rows)))], pa.binary())], names=["machine"])

    # The sample is one partition: it is learned from in one task, and only the machine comes to the driver.
    made = rows.select("label", "terms").mapInArrow(run, "machine binary").first()
    return pickle.loads(made.machine) if made else None


def fitted(sets: list[np.ndarray], toxic_rows: np.ndarray) -> Machine:
    """A machine of the terms that tell the labels of ``sets``."""
    rate = float(np.clip(toxic_rows.mean(), 1e-6, 1 - 1e-6))
    counts = bucket_counts(sets)
    buckets = np.flatnonzero(counts).astype(np.int32)
    docs_with, toxic_with = counts[buckets], bucket_counts([s for s, toxic in zip(sets, toxic_rows, strict=True) if toxic])[buckets]
    del counts
    distance = np.abs(toxic_with - rate * docs_with) / np.sqrt(docs_with * rate * (1 - rate))
    often = np.flatnonzero(docs_with >= MIN_DOCS)
    telling = often[distance[often] >= MIN_Z]
    alone = np.sort(telling[np.argsort(-distance[telling], kind="stable")[:TERMS]])
    frequent = np.sort(often[np.argsort(-docs_with[often], kind="stable")[:TERMS]])
    chances = expected(buckets[alone], docs_with[alone], sets, toxic_rows)
    paired = in_telling_pairs(buckets[frequent], sets, toxic_rows, chances)
    kept = np.union1d(alone, np.searchsorted(buckets, paired))
    return trained(buckets[kept], docs_with[kept], sets, toxic_rows, paired)


def scored(docs: DataFrame, machine: Machine | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for first, buckets, bounds in term_sets(batch.column(1)) if model else ():
                logit, _ = model.logits(*model.known(buckets, bounds))
                scores[first:first + len(logit)] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(
        "doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, machine: Machine | None, text: str = "text") -> DataFrame:
    """``docs`` without the rows that score THRESHOLD or more; no shuffle."""
    schema = docs.schema
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, buckets, bounds in term_sets(batch.column(at)) if model else ():
                logit, _ = model.logits(*model.known(buckets, bounds))
                keep[first:first + len(logit)] = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) < THRESHOLD
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
