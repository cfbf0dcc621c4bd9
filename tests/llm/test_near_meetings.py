"""Nodes that share a pivot meet by the shingles they share: those of one node alone make no rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from gleanery.llm import near_dedup


def versions(n, seed=5):
    """A base text, ``n`` texts with some words of their own, and pairs of them that share a word outside the base."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, n + 1):
        words = list(base)
        for j in rng.sample(range(200), 3):
            words[j] = f"own{i}x{j}"
        if i % 2:
            spot = rng.randrange(200)
        words[spot] = f"both{(i + 1) // 2}"
        rows.append((i, " ".join(words)))
    return rows


def linked(rows):
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in rows}
    least = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if b < a and 100 * len(sets[a] & sets[b]) >= near_dedup.PERCENT * len(sets[a] | sets[b]):
                low, high = sorted((least[a], least[b]))
                least = {k: low if v == high else v for k, v in least.items()}
    return least


@pytest.mark.parametrize("n", [60, 240])
def test_rows_are_what_nodes_share_outside_their_pivot(spark, monkeypatch, n):
    rows, seen, whole = versions(n), {}, near_dedup._in_buckets

    def entries(items, buckets):
        if "n_outside" in items.columns:
            seen.update(made=items.count(), met=buckets.agg({"nodes": "sum"}).first()[0] or 0)
        return whole(items, buckets)

    monkeypatch.setattr(near_dedup, "_in_buckets", entries)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == linked(rows)
    assert 0 < seen["met"] <= seen["made"] <= 1.1 * seen["met"]


def test_a_full_bitmap_only_lets_more_pass(spark, monkeypatch):
    docs = spark.createDataFrame(versions(60), "doc_id long, text string")
    few = near_dedup.near_duplicates(docs).select("doc_id", "component_id").collect()
    monkeypatch.setattr(near_dedup, "_met_twice", lambda pivoted: np.full(near_dedup.SIEVE_BITS // 8, 255, np.uint8))
    assert sorted(near_dedup.near_duplicates(docs).select("doc_id", "component_id").collect()) == sorted(few)
