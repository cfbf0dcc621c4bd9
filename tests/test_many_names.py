"""Seed names as a table: what one automaton finds, without one in every task."""

from __future__ import annotations

import random

import numpy as np

from gleanery import workload
from gleanery.functions import windows
from gleanery.operators import entities


def _found(rows):
    return sorted(tuple(r) for r in rows.select("doc_id", "kind", "display", "at.n").collect())


def test_a_table_of_names_finds_what_the_automaton_finds(spark, monkeypatch):
    pick = random.Random(5)
    letters = "abABäÉ ß€."
    word = lambda most: "".join(pick.choice(letters) for _ in range(pick.randint(0, most)))
    docs = spark.createDataFrame(
        [(i, "s", word(12) or None, word(40) or None) for i in range(1200)] + [(5000, "s", "", None), (5001, "s", "x", "x" * 3000 + "AB")],
        "doc_id long, source string, path string, title string")
    seeds = entities.Seeds(tuple(word(5) for _ in range(80)) + ("  ", "ab", "AB ", "x" * 2999), tuple(word(3) for _ in range(20)) + ("ab",))
    by_automaton = _found(entities.mention_occurrences(docs, seeds))
    monkeypatch.setattr(entities, "AUTOMATON_CHARS", 1)
    assert _found(entities.mention_occurrences(docs, seeds)) == by_automaton and len(by_automaton) > 1000
    real = windows.bitmap

    def full(names, name):
        bits, lengths, shared = real(names, name)
        return bits, lengths, spark.sparkContext.broadcast(np.full_like(shared.value, 255))

    monkeypatch.setattr(windows, "bitmap", full)  # lets every window pass; the join decides
    monkeypatch.setattr(windows, "ROWS_AT_ONCE", 7)
    assert _found(entities.mention_occurrences(docs, seeds)) == by_automaton


def test_no_task_holds_all_names(spark, monkeypatch):
    def refused(self):
        raise AssertionError("an automaton of all names")

    monkeypatch.setattr(entities.Names, "found_in", refused)
    assert workload.mentions_of_all(spark, "/root/testdata/sf0.001").count() > 0


def test_a_table_without_names(spark):
    docs = spark.createDataFrame([(1, "s", "p", "t")], "doc_id long, source string, path string, title string")
    none = spark.createDataFrame([], "n int, kind string, name string")
    assert entities.mentions_in_table(docs, none).count() == 0
