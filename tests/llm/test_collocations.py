"""Collocations against brute force, with small limits, small slices and colliding codes."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gleanery.llm import collocations

SCHEMA = "doc_id long, text string, lang string, n long, code long, rank int, score string, codes string"


def brute(rows, min_count, limit):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    gone = set()
    for p, a in candidates.items():
        for size in range(2, len(p) - 1):
            for i in range(1, len(p) - size + 1):
                inner = (p[0], *p[i:i + size])
                if 100 * a >= 80 * candidates[inner]:
                    gone.add(inner)
    out = []
    for lang in n:
        best = []
        for p, a in candidates.items():
            if p[0] == lang and p not in gone:
                cuts = [(2000000 * a // (f[p[:k + 1]] + f[(lang, *p[k + 1:])]), k) for k in range(1, len(p) - 1)]
                score, k = min(cuts)
                best.append((-score, -a, " ".join(p[1:]).encode(), f[p[:k + 1]], f[(lang, *p[k + 1:])]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus():
    rng = random.Random(8)
    vocab = ["The", "of", "and", "ß", "élan", "x|y", "\x00z", "long" * 9, *"abcdefgh"]
    texts = []
    for _ in range(120):
        words = [rng.choice(vocab[:4 + rng.randrange(len(vocab) - 3)]) for _ in range(rng.randrange(60))]
        if rng.random() < 0.4:
            words[3:3] = ["Strait", "of", "Dover"]
        if rng.random() < 0.3:
            words[5:5] = ["kingdom", "come", "as", "it", "were"]
        texts.append("".join(w + rng.choice([" ", " ", " ", "\t", ", ", ". ", "\n", "!? ", "\x0b", "\r\n"]) for w in words))
    texts += [None, "", " \n", "..", "the the the the the the", "a " * 3000, "Strait of Dover"]
    rows = [(i, t, rng.choice(["en", "en", "en", "fr", None, "und"]), 1, 2, 3, "s", "c") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, "the of the of", "de", 1, 2, 3, "s", "c")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def got(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = collocations.collocations(docs, **options)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert [t for c, t in out.dtypes if c not in ("lang", "phrase")] == ["bigint"] * 6
    return sorted(tuple(r) for r in out.collect())


def test_collocations(spark, rows):
    want = brute(rows, 5, 40)
    assert {r[0] for r in want} == {"en", "fr", "und"} and len(want) > 60
    assert got(spark, rows, min_count=5, limit=40) == want


def test_top_in_rounds_and_contract_limits(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "RANKED_AT_ONCE", 8)
    assert got(spark, rows, min_count=3, limit=2) == brute(rows, 3, 2)
    assert got(spark, rows) == brute(rows, 30, 2000)


def test_codes_that_name_two_words_are_not_used(spark, rows):
    few = rows[:30]
    seeds = [collocations.frequent_phrases(spark.createDataFrame(few, SCHEMA).select("text", "lang"), 5, s, 7) for s in range(4)]
    assert None in seeds
    assert got(spark, few, min_count=5, limit=40, bits=14) == brute(few, 5, 40)


def test_small_slices(rows, monkeypatch):
    """Texts longer than a slice are cut only where pieces end."""
    import pyarrow as pa

    def phrases():
        out = Counter()
        for codes, _, _, fresh, *_ in collocations.occurrences(pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), 0):
            out.update((int(a), int(b)) for a, b, new in zip(codes, codes[1:], fresh[1:]) if not new)
        return out

    whole = phrases()
    monkeypatch.setattr(collocations, "TEXT_BYTES", 40)
    assert phrases() == whole


def test_relation_rows_are_cut_at_gaps(monkeypatch):
    import numpy as np

    monkeypatch.setattr(collocations, "ROW", 4)
    codes = np.array([0, 1, 2, 3, 4, 5, 6, 7, 0, 8, 9, 0, 0, 1, 2, 0], np.uint64)
    rows = collocations.rows_of(codes)
    joined = np.concatenate(list(collocations.flat_runs(rows)))
    for k in (1, 2, 3):
        a, b = (collocations.phrase_hashes(c, collocations.adjacent(c, k), k) for c in (codes, joined))
        assert sorted(a) == sorted(b)
    assert len(rows) > 1


def test_nothing_to_mine(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = spark.createDataFrame([(1, "a b", None, 1, 2, 3, "s", "c"), (2, None, "en", 1, 2, 3, "s", "c")], SCHEMA)
    assert collocations.collocations(lone).count() == 0
    assert [r[:5] for r in got(spark, lone.collect(), min_count=1, limit=5)] == [("und", 1, "a b", 1, 1)]
