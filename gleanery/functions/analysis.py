"""The index analyser: split into words, fold case and accents, stem.

Splitting and folding are JVM expressions. Only stemming needs Python, and it
runs as an Arrow function over arrays of words with a per-worker memo, so each
distinct word is stemmed once per worker.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERM_ENTRIES = T.ArrayType(
    T.StructType()
    .add("term", T.StringType())
    .add("tf", T.IntegerType())
    .add("positions", T.ArrayType(T.IntegerType()))
)
WORD_PATTERN = r"[\p{L}\p{N}\p{Co}]+"
ANALYSERS = ("simple", "porter")
WORDS_AT_ONCE = 1 << 18  # words whose places are sorted at once

# Suffix rules of the 1980 Porter paper, by step.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
_SHORTEST, _LONGEST = 3, 64  # words outside this many bytes are left alone


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``: accented letter -> base letter.

    Built from Unicode decompositions: a code point that decomposes in one step
    to an ASCII letter plus one combining mark maps to that letter. Combining
    marks themselves map to nothing (``translate`` deletes what has no partner).
    """
    accented, base = [], []
    for cp in range(0xC0, 0x2000):
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            first, mark = (chr(int(p, 16)) for p in parts)
            if first.isascii() and first.isalpha() and unicodedata.combining(mark):
                accented.append(chr(cp))
                base.append(first.lower())
    marks = [chr(cp) for cp in range(0x300, 0x332)]
    return "".join(accented + marks), "".join(base)


def fold(text: Column) -> Column:
    source, target = accent_table()
    return F.translate(F.lower(text), source, target)


def words(text: Column, analyser: str = "simple") -> Column:
    """``array<string>`` of index words in text order."""
    if analyser == "simple":
        return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD_PATTERN})"), 1)
    if analyser == "folded":  # the porter analyser before stemming
        return F.regexp_extract_all(fold(text), F.lit(f"({WORD_PATTERN})"), 1)
    if analyser == "porter":
        return stem_words(words(text, "folded"))
    raise ValueError(f"unknown analyser {analyser!r}")


def word_count(text: Column, analyser: str = "porter") -> Column:
    """Number of index words, without building them."""
    if analyser == "simple":
        return F.regexp_count(F.lower(text), F.lit(WORD_PATTERN))
    # Folding removes accent marks, so they continue a word.
    return F.regexp_count(text, F.lit(WORD_PATTERN + r"(?:[\x{300}-\x{331}]+[\p{L}\p{N}\p{Co}]*)*+"))


def _shape(stem: str) -> str:
    """Consonant/vowel pattern; 'y' is a vowel exactly after a consonant."""
    out = []
    for ch in stem:
        vowel = ch in "aeiou" or (ch == "y" and bool(out) and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _ends_cvc(stem: str) -> bool:
    return stem[-1:] not in ("w", "x", "y") and _shape(stem).endswith("cvc")


def _has_vowel(stem: str) -> bool:
    return bool(re.search("[aeiou]|(?<=.)y", stem, re.DOTALL))


def _longest(word: str, suffixes) -> str | None:
    hits = [s for s in suffixes if len(word) > len(s) and word.endswith(s)]
    return max(hits, key=len) if hits else None


def _plural(w: str) -> str:
    if not w.endswith("s") or w.endswith("ss"):
        return w
    return w[:-2] if _longest(w, ("sses", "ies")) else w[:-1]


def _past(w: str) -> str:
    ending = _longest(w, ("eed", "ed", "ing"))
    if ending is None:
        return w
    root = w[: -len(ending)]
    if ending == "eed":
        return root + "ee" if _measure(root) else w
    if not _has_vowel(root):
        return w
    if _longest(root, ("at", "bl", "iz")):
        return root + "e"
    if root[-1:] == root[-2:-1] and root[-1:] not in "aeioulsz":
        return root[:-1]
    if _measure(root) == 1 and _ends_cvc(root):
        return root + "e"
    return root


def _replace(w: str, rules: dict[str, str]) -> str:
    ending = _longest(w, rules)
    if ending and _measure(w[: -len(ending)]):
        return w[: -len(ending)] + rules[ending]
    return w


def _drop(w: str) -> str:
    ending = _longest(w, _STEP4)
    if ending is None:
        return w
    root = w[: -len(ending)]
    if ending == "ion" and root[-1:] not in ("s", "t"):
        return w
    return root if _measure(root) > 1 else w


def _final(w: str) -> str:
    if w.endswith("e"):
        root = w[:-1]
        m = _measure(root)
        if m > 1 or (m == 1 and not _ends_cvc(root)):
            w = root
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


_STEP2_RULES, _STEP3_RULES = dict(_STEP2), dict(_STEP3)


@lru_cache(maxsize=500_000)
def stem(word: str) -> str:
    """Porter stem of a folded word. Bytes above ASCII act as consonants."""
    raw = word.encode("utf-8", "surrogatepass")
    if not _SHORTEST <= len(raw) <= _LONGEST:
        return word
    w = _past(_plural(raw.decode("latin-1")))
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _final(_drop(_replace(_replace(w, _STEP2_RULES), _STEP3_RULES)))
    return w.encode("latin-1").decode("utf-8", "replace")


def _encode(column: pa.Array, analyser: str) -> tuple[np.ndarray, pa.Array]:
    """(code of every word of an array column, terms by code); stems if asked to."""
    flat = column.flatten().dictionary_encode()
    codes, terms = flat.indices.to_numpy(), flat.dictionary
    if analyser == "porter":
        stems = pa.array([stem(w) for w in terms.to_pylist()], pa.string()).dictionary_encode()
        codes, terms = stems.indices.to_numpy()[codes], stems.dictionary
    return codes, terms


def _offsets(lengths) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_words(column: pa.Array) -> pa.Array:
    """Stem every word of an array column, keeping the array layout."""
    codes, terms = _encode(column, "porter")
    lengths = pc.fill_null(column.value_lengths(), 0).to_numpy()
    return pa.ListArray.from_arrays(_offsets(lengths), terms.take(pa.array(codes)), mask=column.is_null())


def term_positions(column: Column | str, analyser: str) -> Column:
    """``array<struct<term, tf, positions>>`` of a word array, one entry per term."""

    def of_slice(column: pa.Array) -> pa.Array:
        codes, terms = _encode(column, analyser)
        lengths = pc.fill_null(column.value_lengths(), 0).to_numpy()
        row = np.repeat(np.arange(len(column)), lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = np.lexsort((place, codes, row))
        row, codes, place = row[order], codes[order], place[order]
        fresh = np.ones(len(codes), dtype=bool)
        fresh[1:] = (row[1:] != row[:-1]) | (codes[1:] != codes[:-1])
        starts = np.flatnonzero(fresh)
        tf = np.diff(np.append(starts, len(codes)))
        entries = pa.StructArray.from_arrays(
            [
                terms.take(pa.array(codes[starts])),
                pa.array(tf, pa.int32()),
                pa.ListArray.from_arrays(_offsets(tf), pa.array(place, pa.int32())),
            ],
            ["term", "tf", "positions"],
        )
        return pa.ListArray.from_arrays(_offsets(np.bincount(row[starts], minlength=len(column))), entries)

    @F.arrow_udf(TERM_ENTRIES)
    def grouped(column: pa.Array) -> pa.Array:
        made = [of_slice(part) for part in word_slices(column)]
        return pa.concat_arrays(made) if len(made) > 1 else made[0]

    return grouped(column)


def word_slices(column: pa.Array) -> list[pa.Array]:
    """An array column in slices of about WORDS_AT_ONCE words, and one row at least."""
    ends = np.cumsum(pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts, first = [0], 0
    while first < len(column):
        before = int(ends[first - 1]) if first else 0
        first = max(first + 1, int(np.searchsorted(ends, before + WORDS_AT_ONCE, "right")))
        cuts.append(first)
    return [column.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] or [column]


@lru_cache(maxsize=1)
def _accent_map() -> dict[int, str | None]:
    source, target = accent_table()
    return {ord(c): target[i] if i < len(target) else None for i, c in enumerate(source)}


def normalise(word: str, analyser: str) -> str:
    """One word as the index stores it."""
    if analyser == "simple":
        return word.lower()
    return stem(word.lower().translate(_accent_map()))


def query_phrases(query: str, analyser: str = "porter") -> list[list[str]]:
    """The query as phrases of index words, all of which must match.

    Every run of word characters is one phrase; the index splits it further at
    characters it does not treat as letters or digits ('foo_bar' -> foo, bar).
    Phrases left without a word are ignored.
    """
    runs = [run.split("_") for run in re.findall(r"\w+", query)]
    phrases = [[normalise(part, analyser) for part in run if part] for run in runs]
    return [phrase for phrase in phrases if phrase]
