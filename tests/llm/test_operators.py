"""The training-data operators on small tables with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import random
import re
import struct
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gleanery.llm import bpe, exact_dedup, language, mixing, near_dedup, quality, queries, repeats, sharding, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _length int, kept string, node long, bucket int"


def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(30, 160))) for _ in range(40)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts = [*base, *base[:8], base[0].upper(), *[base[1]] * 12]
    for t in base[8:30]:  # near copies
        words = t.split()
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(" ".join(words))
    many = base[2].split()
    for i in range(25):  # one large group of near copies
        texts.append(" ".join(many[:i] + ["x" * (i + 1)] + many[i:]))
    texts += [f"{t} {passage} {t[::-1]}" for t in base[:6]]
    texts += [None, "", " \n\t", "a b", "a b", "one two three four", "x" * 300_000, "ab " * 4000, "Ωmega ΣΑΣ İ 12 don't <|endoftext|>"]
    rng.shuffle(texts)
    rows = [(i * 3, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s2", None]), 1, 2, "k", 3, 4) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, "of no id", "en", "s1", 1, 2, "k", 3, 4)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    from gleanery.session import ship_package

    ship_package(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_exact(docs, rows, empty):
    groups = defaultdict(list)
    for r in rows:
        groups[fold(r[1])].append(r[0])
    got = exact_dedup.exact_duplicates(docs, digests=True).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: fold(r[1]) for r in rows}
    for g in got:
        ids = groups[by_id[g.doc_id]]
        keep = max((i for i in ids if i is not None), default=None)
        assert (g.keep_id, g.group_size, g.kept) == (keep, len(ids), g.doc_id == keep)
        assert g.text_sha256 == hashlib.sha256(by_id[g.doc_id].encode()).hexdigest()
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(g.doc_id for g in got if g.kept)
    assert exact_dedup.exact_duplicates(empty).count() == exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(r[0], 1) for r in rows if r[0] is not None], "doc_id long, quality int")
    got = {g.doc_id: g for g in quality.quality_verdicts(docs, labels).collect()}
    for doc_id, text in {r[0]: r[1] for r in rows}.items():
        w, body = words(text), text or ""
        windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        counts = Counter(windows)
        covered = {i + j for i, x in enumerate(windows) if counts[x] > 1 for j in range(5)}
        lines = [x for x in body.split("\n") if words(x)]
        g = got[doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", body)), len(lines) - len(set(lines)), len(covered))
        assert g.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert g.kept == (not g.base_failed)  # too few labels for any cutoff
    assert quality.quality_verdicts(empty, labels).count() == 0


def test_quality_cutoffs_are_risk_controlled(spark):
    from math import comb

    from pyspark.sql import functions as F

    tail = spark.range(1).select(quality.binomial_tail(F.lit(3).cast("long"), F.lit(900).cast("long"), 0.01)).first()[0]
    assert tail == pytest.approx(sum(comb(900, i) * 0.01 ** i * 0.99 ** (900 - i) for i in range(4)))
    good = [(i, " ".join(f"w{(i * 7 + j * j) % 911}" for j in range(40)), "en") for i in range(1200)]
    bad = [(5000 + i, " ".join(f"w{(i * 7 + j * j) % 911}***" for j in range(40)), "en") for i in range(20)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(1200)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_verdicts(table, labels).collect()}
    assert all(got[i].kept for i in range(1200))
    assert all(got[5000 + i].rejected_by == "symbols_per_word" for i in range(20))


def test_bpe_agrees_with_the_library(docs, rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    content = queries.tokenizer_file()
    library = tokenizers.Tokenizer.from_str(content)
    library.no_truncation()
    library.no_padding()
    got = {g.doc_id: g for g in bpe.round_trip(docs, content).collect()}
    for doc_id, text in {r[0]: r[1] for r in rows}.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        g = got[doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(empty, content).count() == 0


def test_transducer_equals_merging_whole_words():
    vocabulary, rng = bpe.Vocabulary(queries.tokenizer_file()), random.Random(3)
    for size in (1, 40, 700, 5000, 20_000):
        data = bytes(rng.choice(b"abeinorst") for _ in range(size))
        whole = vocabulary.merged([*(vocabulary.inner[b] for b in data[:-1]), vocabulary.final[data[-1]]])
        assert list(vocabulary.stream(data[i:i + 7] for i in range(0, size, 7))) == whole
    text = "".join(bpe.decoded(vocabulary, b"".join(bpe.Encoder(vocabulary).packed(["naïve 中文 café"]))))
    assert text == "naïve 中文 café "


def test_sharding(docs, rows, empty):
    got = sharding.shards(docs, n_shards=7).collect()
    assert len(got) == len(rows)
    sizes = Counter(g.shard for g in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
    per_source = Counter((g.source, g.shard) for g in got)
    for source, n in Counter(g.source for g in got).items():
        assert all(abs(per_source[source, s] - n / 7) <= 2.5 for s in range(7))
    for s in sizes:
        assert sorted(g.slot for g in got if g.shard == s) == list(range(sizes[s]))
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all((g.size, g.text_crc32) == (len(text[g.doc_id]) + 16, zlib.crc32(text[g.doc_id])) for g in got)
    assert sharding.shards(empty).count() == 0


def test_mixing(docs, rows, empty):
    weights = {"s1": 3, "s2": 2}
    got = sorted(mixing.mixed(docs, weights, 1, block_rows=4).collect(), key=lambda g: (g.mix_block, g.mix_row))
    assert len(got) == len(rows) and len({(g.mix_block, g.mix_row) for g in got}) == len(rows)
    blocks = [g.source for i, g in enumerate(got) if i == 0 or g.mix_block != got[i - 1].mix_block]
    totals = Counter(blocks)
    sent, slots = Counter(), 0
    while all(totals[s] - sent[s] >= weights.get(s, 1) for s in totals):  # full periods: less than a block off at every slot
        share = sum(weights.get(s, 1) for s in totals)
        for t in range(share):
            sent[blocks[slots]] += 1
            slots += 1
            assert all(abs(sent[s] - slots * weights.get(s, 1) / share) < 1 for s in totals)
    assert Counter(r.doc_id for r in mixing.mixed_rows(docs, weights=weights).collect()) == Counter(r[0] for r in rows)
    assert mixing.mixed(empty).count() == mixing.mixed_rows(empty).count() == 0


def test_pipeline_returns_the_mixture(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    sources = {i: ("src0", "src1", "other")[i % 3] for i in range(1200)}
    table = spark.createDataFrame(
        [(i, " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(12)), s) for i, s in sources.items()],
        "doc_id long, text string, source string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda g: (g.mix_block, g.mix_row))
    assert sorted(g.doc_id for g in got) == sorted(sources)
    blocks = defaultdict(list)
    for g in got:
        blocks[g.mix_block].append(sources[g.doc_id])
    assert sorted(blocks) == list(range(75)) and all(len(set(b)) == 1 for b in blocks.values())
    for first in range(0, 42, 7):  # src0 has 25 blocks, 4 of each 7
        assert Counter(blocks[b][0] for b in range(first, first + 7)) == {"src0": 4, "src1": 2, "other": 1}


def brute_components(rows):
    sets = {}
    for doc_id, text in {r[0]: r[1] for r in rows if r[0] is not None}.items():
        w = words(fold(text))
        sets[doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near(docs, rows, empty):
    want = brute_components(rows)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in got if g.doc_id is not None} == want
    left = near_dedup.drop_near_duplicates(docs)
    assert set(left.columns) == set(docs.columns)
    assert {r.doc_id for r in left.collect()} == {i for i, (_, c) in want.items() if i == c} | {None}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_sketch_fills_and_estimates():
    import numpy as np

    one = np.arange(1, 401, dtype=np.uint64) * np.uint64(7919)
    sketch = near_dedup.sketches([one, one[:320], one[:1]])
    assert (sketch != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((sketch[0] == sketch[1]).mean() - 0.8) < 0.15


def test_warc(spark, tmp_path):
    big = "<p>" + "é" * 900
    pages = [(1, "http://a/1", big), (2, "http://a/2", big), (-5, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big),
             (7, "u", "".join(random.Random(1).choices("abcdef", k=200_000)))]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {g.page_id: g for g in warc.archive_round_trip(table).collect()}
    assert len(got) == len(pages)
    for page_id, _, html in pages:
        body, g = (html or "").encode(), got[page_id]
        twin = html == big and page_id != 2
        assert (g.payload_bytes, g.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (g.record_type, g.refers_to) == (("revisit", 2) if twin else ("response", None))
    member = warc.record(1, "u", b"x", hashlib.sha1(b"x").hexdigest(), None)
    headers, block = next(warc.records(warc.inflated(member + warc.EMPTY_MEMBER)))
    assert warc.parsed(headers, block)[-1] == b"x"
    with pytest.raises(ValueError):
        warc.parsed(headers, block + b"y")
    with pytest.raises(ValueError):
        list(warc.records(warc.inflated(member[:-12])))
    assert warc.archive_round_trip(table.limit(0)).count() == 0


def test_models(spark, docs, rows, empty):
    rng = random.Random(2)
    kinds = {"aa": "abcdeth", "zz": "uvwxyzq"}
    table = spark.createDataFrame([
        (i, " ".join("".join(rng.choices(kinds[k], k=5)) for _ in range(60)) + (" vileword" if i % 5 == 0 else ""), k)
        for i, k in ((i, ("aa", "zz")[i % 2]) for i in range(600))], "doc_id long, text string, lang string")
    network = language.learn(table)
    got = language.identified(table, network).join(table, "doc_id").collect()
    assert sum(g.lang_pred == g.lang for g in got if g.held_out) >= 0.95 * sum(g.held_out for g in got)
    edge = {g.doc_id: g for g in language.identified(docs, network).collect()}
    for r in rows:
        lettered = any(c.isalpha() for c in r[1] or "")
        assert (edge[r[0]].lang_pred == "und") == (not lettered) and 0 <= edge[r[0]].score <= 1
    assert {g.lang_pred for g in language.identified(docs, None).collect()} == {"und"}
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    machine = toxicity.learn(table, labels)
    scores = {g.doc_id: g for g in toxicity.scored(table, machine).collect()}
    assert all(scores[i].predicted == int(i % 5 == 0) for i in range(600))
    assert toxicity.without_toxic(table, machine).count() == 480
    assert toxicity.scored(docs, machine).count() == len(rows)
    assert toxicity.learn(table, labels.limit(0)) is None
    assert toxicity.scored(empty, machine).count() == language.identified(empty, network).count() == 0


def test_toxic_pair_of_harmless_terms(spark):
    rng = random.Random(8)
    filler = ["".join(rng.choices("abcdeth", k=5)) for _ in range(300)]
    rows, labels, both = [], [], set()
    for i in range(1600):
        words = rng.choices(filler, k=30)
        if i % 20 == 0:
            words += ["groupname", "slurlike"]
            both.add(i)
        elif i % 2:
            words.append(rng.choice(["groupname", "slurlike"]))
        elif i % 8 == 2:
            words.append("vileword")
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i in both or "vileword" in words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    machine = toxicity.learn(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = [g for g in toxicity.scored(table, machine).collect() if g.held_out]
    assert sum(g.doc_id in both for g in got) >= 10
    assert [g.predicted for g in got] == [dict(labels)[g.doc_id] for g in got]


def test_repeats(docs, rows, empty):
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    first = {}
    for doc_id in sorted(i for i in texts if i is not None):
        for p in range(len(texts[doc_id]) - 49):
            first.setdefault(texts[doc_id][p:p + 50], doc_id)
    got = repeats.removed_repeats(docs).collect()
    assert len(got) == len(rows)
    for g in got:
        body = texts[g.doc_id]
        gone, reach = bytearray(len(body)), 0
        for p in range(len(body) - 49 if g.doc_id is not None else 0):
            if first[body[p:p + 50]] < g.doc_id:
                gone[max(p, reach):p + 50] = b"\1" * (p + 50 - max(p, reach))
                reach = p + 50
        left = bytes(b for b, x in zip(body, gone) if not x)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        assert (g.n_bytes, g.n_removed, g.n_spans) == (len(body), sum(gone), spans)
        assert g.kept_sha256 == hashlib.sha256(left).hexdigest()
    assert repeats.removed_repeats(empty).count() == 0


def test_repeats_deals_a_common_passage_by_its_strings(spark):
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh ", k=120))
    own = ["".join(rng.choices("ijklmnop ", k=60)) for _ in range(400)]
    texts = {i: f"{own[i]}{passage}{own[-1 - i]}" for i in range(400)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(1)
    sent = Counter()
    for r in repeats.anchors(table, 64).where(f"kind = {repeats.ANCHORS}").collect():
        sent.update(repeats.unpack([r.body], repeats.ANCHOR)["h"].tolist())
    assert max(sent.values()) <= repeats.HOT
    whole = spark.createDataFrame(
        [(repeats.OPEN, 0, repeats.pack({k: repeats.np.array(v) for k, v in {
            "doc": list(texts), "tag": [repeats.checksum(t.encode()) for t in texts.values()],
            "lo": [0] * 400, "hi": [240] * 400}.items()}, repeats.RANGE))], repeats.PACKED)
    names = Counter()
    grouped = repeats._by_group(table, 64).withColumn("bucket", repeats.F.lit(0))
    for r in repeats.named(grouped, whole, 64).where(f"kind = {repeats.ANCHORS}").collect():
        rows = repeats.unpack([r.body], repeats.NAME)
        assert set(rows["c"] % 64) == {r.bucket}
        names.update(zip(rows["h"].tolist(), rows["c"].tolist()))
    assert max(names.values()) == 1
    first, expected = set(), {}
    for i, t in texts.items():
        gone = {q for p in range(len(t) - 49) if t[p:p + 50] in first for q in range(p, p + 50)}
        first |= {t[p:p + 50] for p in range(len(t) - 49)}
        expected[i] = len(gone)
    assert {g.doc_id: g.n_removed for g in repeats.removed_repeats(table).collect()} == expected
