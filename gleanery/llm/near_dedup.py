"""Near-duplicate detection: fast similarity sketching, banding, exact verification, components.

A text's set holds its distinct shingles of five words (A-Z lower-cased), as 64-bit hashes. The sketch has
BINS coordinates. In round i every shingle falls into the bin that a hash of (i, shingle) names and offers
the value (i, hash); a bin keeps its least value, so a later round only fills bins that are still empty.
Rounds 0 to BINS - 1 choose bins at random, round BINS + b puts every shingle into bin b, so that after
2 * BINS rounds every coordinate is filled, and far earlier for all but the smallest sets. Two sets agree
in a coordinate with a probability of their similarity, with the concentration of sampling without
replacement. BANDS bands of BINS / BANDS coordinates give the candidates: a pair at similarity 0.75 is
missed with a probability of (1 - 0.75^4)^32 < 6e-6, and less above.

Equal sets are one node. A bucket of at most SMALL nodes compares all its pairs. In a larger one every node is
compared with a pivot P, the node that shares most buckets with others. A link of A and B needs at least
3/7 (|A| + |B|) common shingles (for 0.75). Where both have that many in common with P, they are compared;
otherwise some of the common shingles lie outside P, at least k of them by what is known of A's overlap with P, and
A and B meet in a bucket named by P and one of the |A - P| - k + 1 shingles of A outside P that are rarest there
(prefix filter). Only shingles that may lie outside the same pivot for two nodes become rows: tasks count them by place in
a bitmap of fixed size, as arrays. Of those buckets only the ones that still hold two components compare their pairs: first by the
ranks at which two nodes meet, then by their shingles outside P, and those that may still be linked by their full sets.
So n near copies cost about n comparisons, not n^2, and no link is lost. Every link used is confirmed on the full sets.

Defined results: null and wordless texts have no set and are linked with nothing; a text of fewer than
five words has its whole sequence as only shingle. Rows that share an id are one document, linked if one of its texts
is. Null ids have components of their own (null). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.components import components
from gleanery.llm.hashing import batch_words, mix, random_table
from gleanery.llm.shared import BITMAP_BITS, SIEVE_BITS, compact, marked, quoted, saved, sieve, with_groups

WORDS, BINS, BANDS = 5, 128, 32
#: Links: PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Nodes of a bucket whose pairs are all compared (28 pairs at most).
SMALL = 8
#: Comparisons with pivots that one task reads; each holds a part of a set.
TASK_ROWS = 2_000
_U = np.uint64
_PLACES = random_table(11, WORDS + 1)
_ROUNDS = random_table(13, 2 * BINS)
_BAND = random_table(17, BINS)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For runs of rows: the first row, and each row's sorted distinct shingle hashes."""
    for first, last, words, rows in batch_words(column):
        bounds = np.searchsorted(rows, np.arange(last - first + 1))
        full = np.zeros(max(0, len(words) - WORDS + 1), _U)
        for j in range(WORDS if len(full) else 0):
            full += words[j:j + len(full)] * _PLACES[j]
        full = mix(full)
        sets = []
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if end - start >= WORDS:
                sets.append(np.unique(full[start:end - WORDS + 1]))
            elif end > start:
                placed = words[start:end] * _PLACES[:end - start]
                sets.append(mix(placed.sum(keepdims=True, dtype=_U) + _PLACES[WORDS:] * _U(end - start)))
            else:
                sets.append(np.zeros(0, _U))
        yield first, sets


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` coordinates per non-empty set. A value is the round (8 bits) before a hash (56 bits)."""
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    empty = _U(0xFFFFFFFFFFFFFFFF)
    table = np.full(len(sets) * bins, empty, _U)
    for i in range(2 * bins):
        hashes = mix(items ^ _ROUNDS[i])
        place = (hashes % _U(bins)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(table, owner * bins + place, _U(i) << _U(56) | hashes >> _U(8))
        open_rows = (table.reshape(len(sets), bins) == empty).any(axis=1)
        if not open_rows.any():
            break
        left = open_rows[owner]
        items, owner = items[left], owner[left]
    return table.reshape(len(sets), bins)


def bands(sketch: np.ndarray, n_bands: int = BANDS) -> np.ndarray:
    """A hash per band, which names the band too."""
    width = sketch.shape[1] // n_bands
    weighted = mix(sketch) * _BAND[:sketch.shape[1]]
    return mix(weighted.reshape(len(sketch), n_bands, width).sum(axis=2, dtype=_U))


def fingerprint(items: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole set."""
    a, b = mix(items ^ _U(0x1234567)), mix(items * _U(0x2545F4914F6CDD1D))
    return int(a.sum(dtype=_U).view(np.int64)), int((b.sum(dtype=_U) ^ np.bitwise_xor.reduce(a)).view(np.int64))


def signatures(docs: DataFrame) -> DataFrame:
    """``docs`` has doc_id and text. Per row: doc_id, n_shingles, fp, fp2, bands (none without shingles)."""
    key = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", key), T.StructField("n_shingles", T.LongType()), T.StructField("fp", T.LongType()),
        T.StructField("fp2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1)):
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                prints = np.zeros((len(sets), 2), np.int64)
                lists = np.zeros((0, BANDS), np.int64)
                if len(some):
                    prints[some] = [fingerprint(sets[i]) for i in some]
                    lists = bands(sketches([sets[i] for i in some])).view(np.int64)
                ends = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(sets)), pa.array(sizes), pa.array(prints[:, 0].copy()),
                    pa.array(prints[:, 1].copy()), pa.ListArray.from_arrays(pa.array(ends), pa.array(lists.ravel())),
                ], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id and its sorted set, for the rows of ``docs`` that have one."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           T.StructField("items", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1)):
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                items = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), pa.ListArray.from_arrays(pa.array(ends), items)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) with the full sets, their overlap and whether they are linked."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("a_items"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("b_items"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.withColumn("overlap", F.size(F.array_intersect("a_items", "b_items")))
    union = F.size("a_items") + F.size("b_items") - F.col("overlap")
    return both.withColumn("linked", 100 * F.col("overlap") >= PERCENT * union)


def _edges(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _unsettled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The entries (bucket, node, n_shingles) of buckets that hold two components, with what describes the bucket.

    ``entries`` are read twice: once to find such buckets, once to keep what a sieve of these lets pass.
    """
    if labels is None:
        placed = entries.withColumn("component", F.col("node"))
    else:
        placed = entries.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    buckets = saved(placed.groupBy("bucket").agg(
        F.count("*").alias("nodes"), F.min("n_shingles").alias("smallest"),
        F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").drop("low", "high"))
    return saved(_in_buckets(placed, buckets))


def _in_buckets(entries: DataFrame, buckets: DataFrame) -> DataFrame:
    """The entries of ``buckets`` with their columns; what a sieve shows to be elsewhere is not shuffled."""
    likely = marked(entries, sieve(buckets.select("bucket")), [F.col("bucket")], "likely").where("likely").drop("likely")
    second = F.expr("pmod(bucket, 1021)")
    return with_groups(likely.withColumn("second", second), "bucket", "second", buckets.withColumn("second", second))


def _open_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of those that are in two components and may be similar."""
    return pairs.where(
        (F.col("component") != F.col("component_b"))
        & (100 * F.least("n_shingles", "n_shingles_b") >= PERCENT * F.greatest("n_shingles", "n_shingles_b"))
    ).select(F.greatest("node", "node_b").alias("a"), F.least("node", "node_b").alias("b")).distinct()


def _pairs(few: DataFrame) -> DataFrame:
    """All open pairs of the buckets given."""
    other = few.select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("node", "n_shingles", "component")])
    return _open_pairs(few.join(other, "bucket").where("node_b < node"))


def _pivoted(many: DataFrame, sets: DataFrame) -> DataFrame:
    """The nodes of large buckets against their pivots.

    node, component, n_shingles, pivot, hashes of both texts (ids may be shared), linked, overlap, the shingles
    outside the pivot's and ``meets``, by how many of these a node has to meet others.
    """
    weight = many.groupBy("node").agg(F.max("second").alias("_"), F.sum("nodes").alias("weight")).drop("_")
    pivots = many.join(weight, "node").groupBy("bucket").agg(
        F.max("second").alias("second"), F.max(F.struct("weight", "node")).alias("top"))
    tests = with_groups(many, "bucket", "second", pivots).where(F.col("node") != F.col("top.node")).groupBy(
        F.col("node").alias("a"), F.col("top.node").alias("b")).agg(
        F.min("smallest").alias("smallest"), F.max("component").alias("component"))
    both = compared(tests, sets).withColumn("outside", F.sort_array(F.array_except("a_items", "b_items")))
    size = F.size("a_items").cast("long")
    least = F.greatest(F.col("smallest"), F.ceil(PERCENT * size / 100))
    k = F.greatest(F.ceil(PERCENT * (size + least) / (100 + PERCENT)) - F.col("overlap"), F.lit(1))
    return both.select(
        F.col("a").alias("node"), "component", size.alias("n_shingles"), F.col("b").alias("pivot"), "linked", "overlap",
        F.xxhash64("a_items").alias("text"), F.xxhash64("b", "b_items").alias("pivot_text"), "outside", (F.size("outside") - k + 1).alias("meets"))


def _loose(pivoted: DataFrame) -> DataFrame:
    """Pairs with the same pivot that may be linked by shingles of the pivot alone."""
    some = pivoted.select("pivot", "node", "n_shingles", "component", "linked", "overlap")
    strays = some.where(~F.col("linked") & (100 * F.col("overlap") >= PERCENT * F.col("n_shingles")))
    other = some.select("pivot", *[F.col(c).alias(f"{c}_b") for c in some.columns if c != "pivot"])
    enough = (100 + PERCENT) * F.least("overlap", "overlap_b") >= PERCENT * (F.col("n_shingles") + F.col("n_shingles_b"))
    same = (strays["pivot"] == other["pivot"]) & (F.col("node") != F.col("node_b")) & enough
    return _open_pairs(strays.join(other, same))


def _places(pivot_texts: pa.Array, outside: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of all rows, where each falls in the bitmap of (pivot's text, shingle), and where rows end."""
    items, sizes = outside.flatten().to_numpy(), outside.value_lengths().to_numpy()
    names = np.repeat(mix(pivot_texts.to_numpy().view(_U)), sizes)
    return items, (mix(names ^ items.view(_U)) % _U(SIEVE_BITS)).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def _met_twice(pivoted: DataFrame) -> np.ndarray:
    """A bitmap of SIEVE_BITS places that two rows' shingles outside a pivot, or more, fall into. Fuller, it lets more pass.

    Each batch sends every place twice at most, and a cell of the bitmap holds a fixed share of the places.
    """
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = np.sort(_places(batch.column(0), batch.column(1))[1])
            spots = spots[np.concatenate([np.ones(min(2, len(spots)), bool), spots[2:] != spots[:-2]])]
            cells, first = np.unique(spots // BITMAP_BITS, return_index=True)
            ends = pa.array(np.append(first, len(spots)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(cells, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(spots % BITMAP_BITS, pa.int32()))], names=["cell", "places"])

    def again(rows: pa.Table) -> pa.Table:
        places = rows.column("places").combine_chunks().flatten().to_numpy()
        bits = np.packbits(np.bincount(places, minlength=BITMAP_BITS) > 1, bitorder="little")
        return pa.table({"cell": rows.column("cell").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    told = pivoted.select("pivot_text", "outside").mapInArrow(tally, "cell int, places array<int>")
    out = np.zeros(SIEVE_BITS // 8, np.uint8)
    for cell, bits in told.groupBy("cell").applyInArrow(again, "cell int, bits binary").collect():
        out[cell * BITMAP_BITS // 8:(cell + 1) * BITMAP_BITS // 8] = np.frombuffer(bits, np.uint8)
    return out


def _shared_outside(pivoted: DataFrame) -> DataFrame:
    """``pivoted`` with ``common``: the shingles outside the pivot that another row may have outside the same pivot."""
    shared = pivoted.sparkSession.sparkContext.broadcast(_met_twice(pivoted))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def common(pivot_texts: pa.Array, outside: pa.Array) -> pa.Array:
        items, spots, bounds = _places(pivot_texts, outside)
        stays = shared.value[spots >> 3] >> (spots & 7).astype(np.uint8) & 1 > 0
        ends = np.concatenate([[0], np.cumsum(stays)])[bounds]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(items[stays]))

    return pivoted.withColumn("common", common("pivot_text", "outside"))


def _meetings(pivoted: DataFrame) -> DataFrame:
    """Entries of the buckets in which nodes meet outside their pivot, and how much the nodes can share from there on.

    ``shared`` is the overlap with the pivot, ``ahead`` the number of shingles outside it from this one on, rarest first.
    """
    items = _shared_outside(pivoted.where("meets > 0")).select(
        "pivot", "pivot_text", "text", F.explode("common").alias("item"), "node", "n_shingles", "meets",
        F.col("overlap").alias("shared"), F.size("outside").alias("n_outside"))
    items = items.withColumn("bucket", F.xxhash64("pivot_text", "item")).drop("item", "pivot_text")
    common = saved(items.groupBy("bucket").agg(F.count("*").alias("nodes")).where("nodes > 1"))
    one_text = Window.partitionBy("pivot", "node", "text")  # one set at most
    # The rarest shingles, those of one node, come first. They are not here: counting the others tells their number.
    alone = F.col("n_outside") - F.count("*").over(one_text)
    met = _in_buckets(items, common).withColumn(
        "rank", alone + F.row_number().over(one_text.orderBy("nodes", "bucket"))).where("rank <= meets")
    return saved(met.select(
        "bucket", "pivot", "node", "n_shingles", "shared", (F.col("n_outside") - F.col("rank") + 1).alias("ahead")))


def _met_pairs(met: DataFrame, pivoted: DataFrame) -> DataFrame:
    """Of the pairs that meet outside a pivot, those that may be linked by all that is known beside the pivot's set.

    Two nodes share at most the lesser of their overlaps with the pivot, and of the shingles outside it no more than
    lie ahead where they meet first (all buckets rank alike); then the shingles outside are counted.
    """
    enough = F.ceil(PERCENT * (F.col("n_shingles") + F.col("n_shingles_b")) / (100 + PERCENT)) - F.least("shared", "shared_b")
    other = met.select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("node", "n_shingles", "component", "shared", "ahead")])
    pairs = met.join(other, "bucket").where("node_b < node AND component != component_b").where(
        (100 * F.least("n_shingles", "n_shingles_b") >= PERCENT * F.greatest("n_shingles", "n_shingles_b"))
        & (F.least("ahead", "ahead_b") >= enough)
    ).select("pivot", "node", "node_b", enough.alias("enough")).distinct()
    outside = pivoted.select("pivot", "node", "outside")
    both = pairs.join(outside, ["pivot", "node"]).join(outside.toDF("pivot", "node_b", "outside_b"), ["pivot", "node_b"])
    return both.where(F.size(F.array_intersect("outside", "outside_b")) >= F.col("enough")).select(
        F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    signed = saved(signatures(docs))
    found = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = found.groupBy("fp", "fp2").agg(F.max("n_shingles").alias("n_shingles"), F.min("doc_id").alias("node"))
    # On a third column that the other two decide, so that large classes can be split (see with_groups).
    members = saved(found.drop("bands").join(classes, ["fp", "fp2", "n_shingles"]).select("doc_id", "n_shingles", "node"))

    nodes = saved(found.join(classes.select("fp", "fp2", F.col("node").alias("doc_id")), ["fp", "fp2", "doc_id"])
                  .dropDuplicates(["fp", "fp2", "doc_id"]).select(F.col("doc_id").alias("node"), "n_shingles", "bands"))
    entries = nodes.select(F.explode("bands").alias("bucket"), "node", "n_shingles")
    rest = _unsettled(entries, None)
    candidates = rest.select("node").distinct()
    chosen = marked(docs, sieve(candidates), [F.col("doc_id")], "candidate").where("candidate")
    sets = saved(full_sets(chosen).join(candidates.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"))

    pivoted = saved(_pivoted(rest.where(F.col("nodes") > SMALL), sets))
    pivoted = compact(pivoted, pivoted.count(), TASK_ROWS)
    pairs = _pairs(rest.where(F.col("nodes") <= SMALL)).union(_loose(pivoted)).distinct()
    links = pivoted.where("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b")).union(
        compared(pairs, sets).where("linked").select("a", "b"))
    labels = components(links)
    left = _met_pairs(_unsettled(_meetings(pivoted), labels), pivoted)
    labels = components(_edges(labels).union(compared(left, sets).where("linked").select("a", "b")))

    with_component = members.join(labels, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    bare = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_component.union(bare).select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that :func:`near_duplicates` does not keep (rows without an id stay)."""
    verdicts = near_duplicates(docs, doc_id, text)
    dropped = verdicts.where("NOT kept").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(dropped, [doc_id], "left_anti")
