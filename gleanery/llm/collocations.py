"""Phrase collocations by set-oriented mining (SETM).

Occurrences are relations sorted by piece and position. The relation of words is made from the texts; the relation of
phrases of k words merge-joins that of k - 1 with itself at adjacent positions of a piece. Phrases are counted per group, and
the relation keeps, by a semi-join, only occurrences of frequent groups before it is extended. Every relation is a Parquet table
in the shared folder: a row holds the word codes of a run of texts in order, with a gap (0) wherever a piece ends or
an occurrence was dropped, so that adjacent entries are joined in place and nothing is shuffled but counts.

A word's code is a 64-bit hash of language and word. Codes of frequent words are checked to name one word each; if
one does not, all starts anew with another seed. Phrases are counted by the tuple of their words' codes, so no hash stands for a phrase. The
semi-join uses a sieve of the frequent groups' hashes: it misses none, and what else it lets through is counted exactly
and dropped then. Scores are computed with decimals, which do not round here.

Defined results: null and empty texts have no words; a null language is ``und``; A-Z are lower-cased; repeated rows count again;
an empty table gives an empty result; ids and other columns are ignored. A piece is held whole by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.hashing import column_bytes, letters, mix, prefix_sums, random_table, slices, span_hashes
from gleanery.llm.shared import quoted, stored

MIN_COUNT, LONGEST, TOP, WITHIN = 30, 4, 2000, 80
#: Bytes of text, and occurrences, that are worked on at once; occurrences that are counted together before they leave a task.
TEXT_BYTES, AT_ONCE, COUNTED = 1 << 19, 1 << 18, 1 << 21
#: Entries of one row of a relation (more if a piece has more): readers hold thousands of rows.
ROW = 128
#: Bits of a sieve per key, and at most (32 MB). Beyond 2^24 keys it lets more and more through; counts stay exact.
BITS_PER_KEY, MOST_BITS = 16, 1 << 28
#: Rows of one language that are ranked by one task.
RANKED_AT_ONCE = 100_000
UNKNOWN = "und"
_U = np.uint64


@lru_cache(1)
def kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every byte: lower case, whether it ends a piece, whether it belongs to a word."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    ends = np.zeros(256, bool)
    ends[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
    word = ~ends
    word[[0x20, 0x09]] = False
    return lower, ends, word


def runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Runs of about TEXT_BYTES: bytes, bounds of the texts in them, first text. Longer texts are cut where pieces end."""
    _, ends, _ = kinds()
    for first, last in slices(offsets, TEXT_BYTES):
        begin, stop = int(offsets[first]), int(offsets[last])
        if last - first > 1 or stop - begin <= TEXT_BYTES:
            yield data[begin:stop], offsets[first:last + 1] - begin, first
            continue
        while begin < stop:
            cut = min(begin + TEXT_BYTES, stop)
            while cut < stop and not ends[data[cut - 1]]:
                found = np.flatnonzero(ends[data[cut:min(cut + TEXT_BYTES, stop)]])
                cut = cut + int(found[0]) + 1 if len(found) else min(cut + TEXT_BYTES, stop)
            yield data[begin:cut], np.array([0, cut - begin]), first
            begin = cut


def languages(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct languages of a batch and the place of each row's."""
    coded = column.cast(pa.string()).fill_null(UNKNOWN).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def language_codes(names: list[str], seed: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{n}".encode(), digest_size=8).digest(), "little") for n in names], _U)


def occurrences(column: pa.Array, langs: pa.Array, seed: int, bits: int = 64):
    """For runs of texts: codes of all words, their starts and ends, whether a piece ends before one, language places, bytes."""
    _, ends, word = kinds()
    values, _ = letters()
    data, offsets = column_bytes(column)
    names, places = languages(langs)
    salts = language_codes(names, seed)
    for body, bounds, first in runs(data, offsets):
        inside = word[body]
        edge = np.zeros(len(body) + 1, bool)
        edge[bounds] = True
        start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
        end = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
        lang = places[first + np.searchsorted(bounds, start, "right") - 1]
        codes = mix(span_hashes(prefix_sums(body, values), start, end) ^ salts[lang]) if len(start) else np.zeros(0, _U)
        codes = np.maximum(codes >> _U(64 - bits), _U(1))
        piece = np.cumsum(ends[body])[start] if len(start) else start
        fresh = np.ones(len(start), bool)
        fresh[1:] = (np.diff(piece) > 0) | edge_between(edge, start)
        yield codes, start, end, fresh, lang, body, names


def edge_between(edge: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether a text begins between one word's start and the next one's."""
    count = np.cumsum(edge)
    return count[start[1:]] > count[start[:-1]]


def word_counts(docs: DataFrame, seed: int, bits: int) -> DataFrame:
    """lang, code, n per run of texts; the words of a language in all where code is null. ``docs`` has text and lang."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, _, _, _, lang, _, names in occurrences(batch.column(0), batch.column(1), seed, bits):
                unique, n = np.unique(codes, return_counts=True)
                some, in_all = np.unique(lang, return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([None] * len(unique) + [names[i] for i in some], pa.string()),
                    pa.concat_arrays([pa.array(unique.view(np.int64)), pa.nulls(len(some), pa.int64())]),
                    pa.array(np.concatenate([n, in_all]).astype(np.int64)),
                ], names=schema.names)

    return docs.mapInArrow(run, schema).groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Sieve:
    """A bitmap of keys, at most MOST_BITS; never misses a key."""

    def __init__(self, keys: DataFrame, column: str, n_keys: int):
        self.mask = min(MOST_BITS, max(1 << 16, 1 << (n_keys * BITS_PER_KEY).bit_length())) - 1
        spot = F.col(column).bitwiseAND(F.lit(self.mask).cast("long")) + 1  # bitmap functions count from 1
        cells = keys.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("cell")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
        self.bits = np.zeros((self.mask + 1) // 8, np.uint8)
        for cell, content in cells.collect():
            self.bits[(cell - 1) * 4096:cell * 4096] = np.frombuffer(content, np.uint8)

    def holds(self, codes: np.ndarray) -> np.ndarray:
        spot = codes & _U(self.mask)
        return self.bits[(spot >> _U(3)).astype(np.int64)] >> (spot & _U(7)).astype(np.uint8) & 1 > 0


RELATION = T.StructType([T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("lang", T.StringType()),
                         T.StructField("word", T.StringType()), T.StructField("code", T.LongType())])


def rows_of(codes: np.ndarray) -> pa.Array:
    """Rows of about ROW entries of a relation, cut at gaps."""
    gaps = np.flatnonzero(codes == 0) + 1
    cuts = gaps[np.minimum(np.searchsorted(gaps, np.arange(ROW, len(codes), ROW)), len(gaps) - 1)] if len(gaps) else gaps
    bounds = np.unique(np.concatenate([[0], cuts, [len(codes)]]))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(codes.view(np.int64)))


def words_relation(docs: DataFrame, frequent: Sieve, seed: int, bits: int) -> DataFrame:
    """The relation of words, a row (codes) for each run of texts; and rows (lang, word, code) that spell the codes."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, _, _ = kinds()
        second = random_table(11, 256)[lower]
        seen = np.zeros(0, _U)  # words this task has spelled: no more than its share of the texts has
        for batch in batches:
            for codes, start, end, fresh, lang, body, names in occurrences(batch.column(0), batch.column(1), seed, bits):
                kept = shared.value.holds(codes)
                spaced = np.zeros(2 * len(codes) + 1, _U)  # room for a gap before each word
                spaced[1::2] = np.where(kept, codes, _U(0))
                stays = np.ones(len(spaced), bool)
                stays[0:-1:2] = fresh
                stays[1::2] = kept | np.concatenate([[True], kept[:-1]])[:len(kept)]
                made = rows_of(spaced[stays])
                yield pa.RecordBatch.from_arrays([
                    made, pa.nulls(len(made), pa.string()), pa.nulls(len(made), pa.string()), pa.nulls(len(made), pa.int64())], names=RELATION.names)
                at = np.flatnonzero(kept)
                check = np.concatenate([np.zeros(1, _U), np.cumsum(second[body])])
                check = check[end[at]] - check[start[at]]  # tells apart words of one code: each is spelled
                names_of, first = np.unique(mix(codes[at]) ^ check, return_index=True)
                news = ~np.isin(names_of, seen, assume_unique=True)
                seen, at = np.union1d(seen, names_of), at[first[news]]
                sizes = end[at] - start[at]
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                spelled = lower[body[np.repeat(start[at] - bounds[:-1], sizes) + np.arange(bounds[-1])]]
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(len(at), pa.list_(pa.int64())), pa.array([names[i] for i in lang[at]], pa.string()),
                    pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(spelled.tobytes())),
                    pa.array(codes[at].view(np.int64)),
                ], names=RELATION.names)

    return docs.mapInArrow(run, RELATION)


def flat_runs(column: pa.Array) -> Iterator[np.ndarray]:
    """The codes of the rows of a relation, several rows at once, a gap between rows."""
    values = column.values.to_numpy().view(_U)
    at = column.offsets.to_numpy()
    for first, last in slices(at, AT_ONCE):
        part = values[at[first]:at[last]]
        yield np.concatenate([np.insert(part, at[first:last] - at[first], _U(0)), np.zeros(1, _U)])


def adjacent(codes: np.ndarray, k: int) -> np.ndarray:
    """Where ``k`` neighbours in order are all words: the places that the merge-join of adjacent positions yields."""
    ok = codes != 0
    out = ok[:len(codes) - k + 1].copy()
    for j in range(1, k):
        out &= ok[j:len(codes) - k + 1 + j]
    return np.flatnonzero(out)


def phrase_hashes(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = codes[at]
    for j in range(1, k):
        out = mix(out * _U(0x9FB21C651E98DF25) + codes[at + j])
    return out


def tallied(batches: Iterator[pa.RecordBatch], keys_of: Callable[[np.ndarray], np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Distinct rows of the keys of a task's runs and how often they come (column n), in blocks of bounded size."""
    limit = COUNTED // len(names)
    kept, counts = np.zeros((0, len(names) - 1), _U), np.zeros(0, np.int64)
    held, size = [], 0

    def block() -> pa.RecordBatch:
        columns = [pa.array(np.ascontiguousarray(kept[:, j]).view(np.int64)) for j in range(kept.shape[1])]
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts)], names=names)

    for codes in (codes for batch in batches for codes in flat_runs(batch.column(0))):
        held.append(keys_of(codes))
        size += len(held[-1])
        if size >= limit:
            kept, counts = summed([kept, *held], counts)
            held, size = [], 0
            if len(kept) >= limit:
                yield block()
                kept, counts = kept[:0], counts[:0]
    kept, counts = summed([kept, *held], counts)
    if len(kept):
        yield block()


def summed(parts: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``parts`` and their counts; rows of the first part have ``counts``, others count once."""
    rows = np.concatenate(parts)
    n = np.ones(len(rows), np.int64)
    n[:len(counts)] = counts
    order = np.lexsort(rows.T)
    rows, n = rows[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])) if len(rows) else order
    return rows[first], np.add.reduceat(n, first) if len(rows) else n


def hash_counts(relation: DataFrame, k: int) -> DataFrame:
    """hash, n: how often phrases of each hash occur, at least as often as any one of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tallied(batches, lambda codes: phrase_hashes(codes, adjacent(codes, k), k)[:, None], ["hash", "n"])

    return relation.select("codes").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def extended(relation: DataFrame, k: int, frequent: Sieve) -> DataFrame:
    """The relation of phrases of ``k`` words: runs of ``relation`` in which every phrase of ``k`` words may be frequent."""
    shared = relation.sparkSession.sparkContext.broadcast(frequent)
    schema = T.StructType([RELATION["codes"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes in flat_runs(batch.column(0)):
                at = adjacent(codes, k)
                at = at[shared.value.holds(phrase_hashes(codes, at, k))]
                if not len(at):
                    continue
                opens = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
                sizes = np.diff(np.concatenate([opens, [len(at)]])) + k  # the words of a run and a gap
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                out = codes[np.repeat(at[opens] - bounds[:-1], sizes) + np.arange(bounds[-1])]
                out[bounds[1:] - 1] = 0
                yield pa.RecordBatch.from_arrays([rows_of(out)], names=["codes"])

    return relation.select("codes").mapInArrow(run, schema)


def phrase_counts(relation: DataFrame, k: int) -> DataFrame:
    """codes (an array of ``k``) and n of every phrase of ``k`` words in its relation."""
    names = [f"c{j}" for j in range(k)]

    def keys(codes: np.ndarray) -> np.ndarray:
        at = adjacent(codes, k)
        return np.stack([codes[at + j] for j in range(k)], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tallied(batches, keys, [*names, "n"])

    counts = relation.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"])).groupBy(*names).agg(F.sum("n").alias("n"))
    return counts.select(F.array(*names).alias("codes"), "n")


def frequent_phrases(docs: DataFrame, min_count: int, seed: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Frequent phrases (codes, n), spelling (code, lang, word), words per language (lang, n); None if two words share a code."""
    counts = stored(word_counts(docs, seed, bits).where(F.col("code").isNull() | (F.col("n") >= min_count)))
    totals = counts.where("code IS NULL").select("lang", "n")
    words = counts.where("code IS NOT NULL").select("code", "n")
    relation = stored(words_relation(docs, Sieve(words, "code", words.count()), seed, bits))
    spelling = stored(relation.where("code IS NOT NULL").select("code", "lang", "word").distinct().join(words.select("code"), "code", "left_semi"))
    if not spelling.groupBy("code").count().where("count > 1").isEmpty():
        return None
    relation = relation.where("codes IS NOT NULL").select("codes")
    found = words.select(F.array("code").alias("codes"), "n")
    for k in range(2, LONGEST + 1):
        hashes = stored(hash_counts(relation, k).where(F.col("n") >= min_count).select("hash"))
        relation = stored(extended(relation, k, Sieve(hashes, "hash", hashes.count())))
        found = found.unionByName(phrase_counts(relation, k).where(F.col("n") >= min_count))
    return stored(found), spelling, totals


def exact(column: str) -> str:
    return f"CAST({column} AS DECIMAL(20, 0))"


def cut_at_best(phrases: DataFrame) -> DataFrame:
    """codes, a, l, r, score of the phrases of two or more words, at the cut with the lowest score."""
    many = phrases.where(F.size("codes") > 1).select("codes", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("codes") - 1)).alias("cut"))
    many = many.select("codes", "a", "cut", F.slice("codes", 1, F.col("cut")).alias("left"), F.slice("codes", F.col("cut") + 1, F.size("codes") - F.col("cut")).alias("right"))
    known = phrases.select(F.col("codes").alias("left"), F.col("n").alias("l"))
    many = many.join(known, "left").join(known.select(F.col("left").alias("right"), F.col("l").alias("r")), "right")
    score = F.expr(f"CAST(2000000 AS DECIMAL(7, 0)) * {exact('a')} div ({exact('l')} + {exact('r')})")
    best = many.select("codes", F.struct(score.alias("score"), "cut", "a", "l", "r").alias("best")).groupBy("codes").agg(F.min("best").alias("best"))
    return best.select("codes", "best.a", "best.l", "best.r", "best.score")


def not_inside_longer(candidates: DataFrame) -> DataFrame:
    """Candidates that no longer one contains with at least WITHIN percent of their occurrences."""
    inner = candidates.where(F.size("codes") > 2).select("codes", "a", F.explode(F.sequence(F.lit(2), F.size("codes") - 1)).alias("size"))
    inner = inner.select("codes", "a", "size", F.explode(F.sequence(F.lit(1), F.size("codes") - F.col("size") + 1)).alias("at"))
    longest = inner.select(F.slice("codes", F.col("at"), F.col("size")).alias("codes"), "a").groupBy("codes").agg(F.max("a").alias("longer"))
    swallowed = F.expr(f"CAST(100 AS DECIMAL(3, 0)) * {exact('longer')} >= CAST({WITHIN} AS DECIMAL(3, 0)) * {exact('a')}")
    return candidates.join(longest, "codes", "left").where(~F.coalesce(swallowed, F.lit(False))).drop("longer")


def spelled(candidates: DataFrame, spelling: DataFrame) -> DataFrame:
    """Candidates with lang and phrase instead of codes."""
    words = candidates.select("*", F.posexplode("codes").alias("pos", "code")).join(spelling, "code")
    kept = [c for c in candidates.columns if c != "codes"]
    whole = words.groupBy("codes", "lang", *kept).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("words"))
    return whole.select("lang", *kept, F.array_join(F.col("words.word"), " ").alias("phrase"))


def top(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each language with their rank. Shares of a large language are ranked first, round by round."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    shares = rows.count() // max(RANKED_AT_ONCE, 4 * limit) + 1
    while shares > 1:
        share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= limit).drop("rank")
        shares = 1 if shares <= 16 else shares // 16
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= limit)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, limit: int = TOP, bits: int = 64) -> DataFrame:
    """Each language's first ``limit`` phrases: lang, rank, phrase, a, l, r, n, score. ``bits`` shortens codes in tests."""
    docs = docs.select(quoted(text).cast("string").alias("text"), quoted(lang).cast("string").alias("lang"))
    seed, mined = 0, None
    while mined is None:
        mined = frequent_phrases(docs, min_count, seed, bits)
        seed += 1
    phrases, spelling, totals = mined
    rows = stored(spelled(not_inside_longer(stored(cut_at_best(phrases))), spelling))
    return top(rows, limit).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
