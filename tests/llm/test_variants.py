"""Spelling variants against brute force, below and above the size at which groups are split."""

import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gleanery.llm import variants

SCHEMA = "doc_id long, text string, word string, n int, root string, key long, low int"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def within_one(a, b):
    """One inserted, deleted or replaced code point, by trying them all."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and within_one(v, w)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return out


def corpus():
    rng = random.Random(3)
    base = ["".join(rng.choice("abeé") for _ in range(rng.randint(7, 11))) for _ in range(60)] + ["lighthouse", "ÉCLAIRAGE", "x" * 40, "ab" * 30]
    texts = []
    for word in base:
        chain = [(word, 400)]
        for n in (20, 2):  # variants of variants
            parent = chain[-1][0]
            i = rng.randrange(len(parent))
            chain.append((rng.choice([parent[:i] + parent[i + 1:], parent[:i] + "q" + parent[i:], parent[:i] + "z" + parent[i + 1:]]), n))
        texts += [" ".join([w] * n) for w, n in chain]
    texts += [" ".join(["harbour" + c, "h" + c + "rbours", c + "arbours"] * 2) for c in "abcdefghijklmnopqrstuvwxyzàéîõü"]
    texts += [None, "", " \n", "short words on ly", "ÀÉÎÕÜßÿ ÀÉÎÕÜßÿ àÉÎÕÜßÿ àÉÎÕÜßÿ", "naïve,naïvely-naïvely", "éclairage éclairage", "y" * 200_000, "y" * 200_000]
    return [(i, t, "w", 1, "r", 5, 6) for i, t in enumerate(texts)] + [(None, "LIGHTHOUSE", "w", 1, "r", 5, 6), (0, texts[0], "w", 1, "r", 5, 6)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.mark.parametrize("hot", [variants.HOT, 3])
def test_variants(spark, rows, hot):
    got = variants.spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(3), hot=hot).collect()
    assert got[0].__fields__ == ["word", "form", "root", "n", "n_near", "form_n"]
    assert len(got) == len({g.word for g in got})
    want = brute(rows)
    assert {tuple(g) for g in got} == want
    assert any(form and root != form for _, form, root, *_ in want)


def test_every_pair_once(spark):
    words = ["".join(c) for c in {f"harbo{a}{b}" for a in "abcdefgh" for b in "abcdefgh"} | {f"harbo{a}" + "u" * k for a in "ab" for k in range(4)}]
    rows = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    for hot in (variants.HOT, 2):
        got = [tuple(sorted((p.a, p.b))) for p in variants.near_pairs(rows, hot).collect()]
        assert sorted(got) == sorted((a, b) for a in words for b in words if a < b and abs(len(a) - len(b)) < 2 and within_one(a, b))


def test_no_words(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert variants.spelling_variants(empty).count() == 0
    lone = spark.createDataFrame([(1, "lighthouse", None, None, None, None, None)], SCHEMA)
    assert variants.spelling_variants(lone).count() == 0
