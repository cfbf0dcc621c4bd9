"""Steps of indexing that hold or move no more than they need."""

import time
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gleanery import session, workload
from gleanery.config import Source
from gleanery.functions import analysis
from gleanery.operators.entities import Aliases, Seeds
from gleanery.plans import index as plans
from gleanery.plans.update import merge_parts, update_source
from gleanery.tables import table_loader, table_probes


def test_words_are_grouped_in_slices():
    words = [["a", "b", "a"], None, [], ["c"] * 700_000, ["b"], ["a", "c"]] * 3
    column = pa.array(words, pa.list_(pa.string()))
    parts = analysis.word_slices(column)
    assert pa.concat_arrays(parts).to_pylist() == words and len(parts) > 6
    assert analysis.word_slices(column.slice(0, 0))[0].to_pylist() == []
    assert pa.concat_arrays(analysis.word_slices(column.slice(4, 9))).to_pylist() == words[4:13]


def test_only_long_lists_are_grouped_into_blocks(spark, tmp_path, monkeypatch):
    grouped = []
    real = plans.blocks_of
    monkeypatch.setattr(plans, "LONG_LIST", 3)
    monkeypatch.setattr(plans, "blocks_of", lambda rows: grouped.append(rows) or real(rows))
    rows = spark.createDataFrame(
        [(t, 1, d, 0, "s", None, 5 + d, 1 + d, [0]) for t, n in (("a", 3), ("b", 2), ("c", 4)) for d in range(n)],
        "term string, batch int, doc_id long, seq int, source string, doc_date string, dl int, tf int, positions array<int>")
    index = plans.Index(spark, str(tmp_path / "index"))
    index.append_postings(rows, 1)
    assert {r.term for r in grouped[0].collect()} == {"a", "c"}
    found = index.read("blocks", parts=[1]) if index.log.has_rows("blocks", 1) else None
    assert {(r.term, r.n, r.max_tf, r.min_dl) for r in found.collect()} == {("a", 3, 3, 5), ("c", 4, 4, 5)}


def test_versions_read_the_documents_once(spark):
    for docs in workload.versions(spark, "/root/testdata/sf0.001"):
        assert "Join" not in docs._jdf.queryExecution().optimizedPlan().toString()


def test_merging_does_not_shuffle_texts(spark, tmp_path, monkeypatch):
    written = {}
    real = plans.Index.append
    monkeypatch.setattr(plans.Index, "append", lambda self, name, rows, *a, **o: written.setdefault(name, []).append(rows) or real(self, name, rows, *a, **o))
    index, _ = workload.stored_index(spark, str(tables(tmp_path, spark)))
    merged = {name: rows[-1]._jdf.queryExecution().executedPlan().toString() for name, rows in written.items()}
    for name in ("documents", "chunks"):
        assert "hashpartitioning" not in merged[name] and "RoundRobin" not in merged[name]
    assert len(index.read("chunks").inputFiles()) == 1  # small parts become one file


def tables(folder, spark):
    """Documents alone, under a path that no other test has built an index of."""
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").write.parquet(str(folder / "documents.parquet"))
    return folder


POSTINGS = "term string, batch int, doc_id long, seq int, source string, doc_date string, dl int, tf int, positions array<int>"


def shuffle_files(spark):
    """Names of the shuffle files that this application has on disk."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f.name for folder in manager.localDirsString() for f in Path(folder).rglob("shuffle_*")}


def test_writing_a_table_leaves_no_shuffle_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"w{i % 50}", 1, i, 0, "s", None, 5, 1, [i]) for i in range(3000)], POSTINGS)
    index, before = plans.Index(spark, str(tmp_path / "index")), shuffle_files(spark)
    stored = index.append("postings", plans.by_span(rows), 1)
    limit = time.monotonic() + 30
    while shuffle_files(spark) - before and time.monotonic() < limit:  # Spark deletes them beside other work
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert stored.count() == 3000


def test_the_setting_that_frees_shuffles_is_put_back(spark):
    before = spark.conf.get(session.FREE_SHUFFLES)
    spark.conf.set(session.FREE_SHUFFLES, "false")
    try:
        with session.freed_shuffles(spark):
            assert spark.conf.get(session.FREE_SHUFFLES) == "true"
        assert spark.conf.get(session.FREE_SHUFFLES) == "false"
    finally:
        spark.conf.set(session.FREE_SHUFFLES, before)


def test_shares_hold_every_posting_once(spark, tmp_path):
    rows = spark.createDataFrame(
        [(f"w{t}", 1, d, 0, "s", None, 5 + d, 1 + t, [t, d]) for d in range(600) for t in range(d % 7)] * 2, POSTINGS)  # rows may come twice
    index = plans.Index(spark, str(tmp_path / "index"))
    index.append_postings(rows, 1)
    index.append_postings(rows, 2, 3)
    index.append_postings(rows, 3, 3, F.shiftright("doc_id", plans.SPAN_BITS))
    whole, by_term, by_document = (index.read("postings", parts=[n]) for n in (1, 2, 3))
    listed = sorted(map(tuple, whole.collect()), key=repr)
    assert len(listed) == rows.count()
    assert sorted(map(tuple, by_term.collect()), key=repr) == listed and sorted(map(tuple, by_document.collect()), key=repr) == listed
    for stored, key in ((by_term, ["term"]), (by_document, ["term", "span"])):  # what is looked up together stays together
        assert stored.select(*key, F.input_file_name().alias("file")).distinct().groupBy(*key).count().where("count > 1").isEmpty()
    index.append_postings(rows.where("term = 'w1'"), 2, 3)  # a run's earlier files do not stay
    assert {r.term for r in index.read("postings", parts=[2]).select("term").distinct().collect()} == {"w1"}


def test_large_tables_are_dealt_into_shares(spark, tmp_path, monkeypatch):
    texts = [spark.createDataFrame(
        [(f"a/{n}.txt", "2024-01-01", f"{word} number {n} of the harbour. " * (n % 5 + 1)) for n in range(first, 700)], "path string, doc_date string, text string")
        for first, word in ((0, "lamp"), (300, "candle"))]
    source, written, states = Source("s", "filetree", "/nowhere"), [], []
    real = plans.Index.append
    monkeypatch.setattr(plans.Index, "append", lambda self, name, rows, part, *a, **o: written.append((name, part)) or real(self, name, rows, part, *a, **o))
    for size in (plans.SHARE_BYTES, 1):
        monkeypatch.setattr(plans, "SHARE_BYTES", size)
        written.clear()
        index = plans.Index(spark, str(tmp_path / f"index{size}"))
        for found in texts:
            update_source(index, source, Seeds(), Aliases(), probes=table_probes(found, source), loader=table_loader(found))
        before = index.live("postings").drop("batch", "doc_id", "span")
        states.append(sorted(map(tuple, before.collect()), key=repr))
        merge_parts(index, Aliases(), full=True)
        states.append(sorted(map(tuple, index.live("postings").drop("batch", "doc_id", "span").collect()), key=repr))
        assert [written.count(("postings", n)) for n in (1, 2, 3)] == [1 if size > 1 else plans.MOST_SHARES] * 3
        # Shuffles of a merge come before its second copy of the texts.
        assert written.index(("postings", 3)) < written.index(("documents", 3)) and written.index(("occurrences", 3)) < written.index(("documents", 3))
    assert states[0] and all(s == states[0] for s in states)


def test_what_a_share_leaves_out_is_not_tokenised(spark, tmp_path, monkeypatch):
    plans_seen = []
    real = plans.Index.append
    monkeypatch.setattr(plans, "SHARE_BYTES", 1)
    monkeypatch.setattr(plans.Index, "append", lambda self, name, rows, *a, **o: (
        plans_seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) if name == "postings" else None) or real(self, name, rows, *a, **o))
    found = spark.createDataFrame([("a.txt", "2024-01-01", "one two")], "path string, doc_date string, text string")
    source = Source("s", "filetree", "/nowhere")
    update_source(plans.Index(spark, str(tmp_path / "index")), source, Seeds(), Aliases(), probes=table_probes(found, source), loader=table_loader(found))
    assert len(plans_seen) == plans.MOST_SHARES
    for plan in plans_seen:  # children stand below: the share is chosen before the words are taken apart
        assert plan.index("xxhash64") > plan.index("Generate")


def test_tables_are_stored_with_zstd(spark, tmp_path):
    rows = spark.createDataFrame([("w", 1, 1, 0, "s", None, 5, 1, [1])], POSTINGS)
    index = plans.Index(spark, str(tmp_path / "index"))
    index.append_postings(rows, 1)
    files = list((tmp_path / "index" / "postings" / "part=1").glob("*.parquet"))
    assert files and all(pq.ParquetFile(f).metadata.row_group(0).column(0).compression == "ZSTD" for f in files)


def test_joins_with_a_table_without_rows_shuffle_nothing(spark, tmp_path):
    index = plans.Index(spark, str(tmp_path / "index"))
    chunks = spark.range(100).select(F.lit(1).alias("batch"), F.col("id").alias("doc_id"), F.lit(0).alias("seq"), F.lit("t").alias("text"))
    waiting = chunks.join(index.read("vectors").select(*plans.CHUNK), plans.CHUNK, "left_anti")
    assert "Exchange" not in waiting._jdf.queryExecution().executedPlan().toString()
    assert waiting.count() == 100


def test_an_empty_source_changes_nothing(spark, tmp_path):
    source = Source("s", "filetree", "/nowhere")
    found = spark.createDataFrame([], "path string, doc_date string, text string")
    index = plans.Index(spark, str(tmp_path / "index"))
    for rows in (found, found.limit(0)):
        done = update_source(index, source, Seeds(), Aliases(), probes=table_probes(rows, source), loader=table_loader(rows))
        assert (done.added, done.changed, done.deleted, done.unchanged) == (0, 0, 0, 0)
