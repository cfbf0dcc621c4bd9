"""What training and Arrow batches hold at once does not grow with the rows looked at."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from gleanery import session
from gleanery.llm import toxicity


def test_pairs_of_a_common_term_are_counted_some_at_a_time(monkeypatch):
    rows, members = 1000, 1200
    labels = np.arange(rows) % 2
    flat = np.tile(np.arange(members, dtype=np.int32), rows)
    ends = np.arange(1, rows + 1) * members
    tally = 1.0 + labels * 2.0 ** 14 + 512 * 2.0 ** 28
    tracemalloc.start()
    found = toxicity.telling_leads(flat, ends, tally, members)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 25e6 and not found.any()
    few = flat.reshape(rows, members)[:, :40].copy()
    few[labels == 1, 5:7] = 38  # terms 5 and 6 only stand in rows of label 0
    sets = [np.unique(r) for r in few]
    args = np.concatenate(sets), np.cumsum([len(s) for s in sets]), tally, members
    whole = toxicity.telling_leads(*args)
    monkeypatch.setattr(toxicity, "PAIRS_AT_ONCE", 7)
    assert whole[[5, 6]].all() and (toxicity.telling_leads(*args) == whole).all()


def test_stages_send_small_batches(spark):
    before = spark.conf.get(session.BATCH_LIMIT)

    def counted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    try:
        corpus_pipeline.exact_out(spark, spark.createDataFrame([], "doc_id long, text string"), "")
        assert spark.conf.get(session.BATCH_LIMIT) == str(session.BATCH_BYTES)
        text = spark.range(300, numPartitions=1).selectExpr("repeat('x', 100000) AS text")
        sizes = text.mapInArrow(counted, "n long").collect()
        assert len(sizes) > 5 and sum(r.n for r in sizes) == 300
        spark.conf.set(session.BATCH_LIMIT, "1m")
        assert session.small_batches(spark).conf.get(session.BATCH_LIMIT) == "1m"
    finally:
        spark.conf.set(session.BATCH_LIMIT, before)

