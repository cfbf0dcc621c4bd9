"""Spelling variants of words by asymmetric q-chunks.

Two words are near if exactly one inserted, deleted or replaced code point tells them apart. The longer word of a
pair (either, if they are equally long) contributes two disjoint chunks, its halves; the other contributes the grams
that stand where those chunks can be. One edit leaves one chunk whole, and moves it by the difference of the lengths,
which is at most one: so the words meet on (length of the longer, place, chunk). Common chunks bring many words
together. Where more than HOT words meet, the open half (the one the edit is in) is cut into two chunks of its own,
and so on: each round halves the open part, and when it is one code point wide, no more words can meet than there are letters (and one without). No group is ever larger than that, and none is cut off. Words that meet are verified; a pair is taken only
where the first differing code point lies in the open part, which happens once.

Words are the maximal runs of letters, A-Z lower-cased; one in STRAY of them loses a code point first. The form of a word is
its near word of largest count, if that count is FACTOR times its own; the root is the end of the chain of forms. As counts grow FACTOR-fold
along a chain, it has at most 18 links, and doubling finds its end within five rounds.

Defined results: null and empty texts have no words; a null id counts as an empty text; repeated rows count again; ties
of counts go to the smallest word in code-point order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.exact_dedup import LOWER, UPPER
from gleanery.llm.shared import marked, quoted, sieve, stored

MIN_CHARS, MIN_COUNT, FACTOR, STRAY = 7, 2, 10, 31
#: Words that may meet in one group. With one open code point, a group has at most 91: one for each letter, and one without it.
HOT = 128


def counted_words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """word and n of all runs of MIN_CHARS code points or more (one less where the run lost one)."""
    # A shorter run cannot give a word, so the pattern need not find it; a longer one is still found whole.
    runs = F.regexp_extract_all(F.coalesce(quoted(text), F.lit("")), F.lit(rf"[A-Za-zÀ-ÿ]{{{MIN_CHARS},}}"), F.lit(0))
    rows = docs.select(F.coalesce(quoted(doc_id).cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    rows = rows.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    short = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    words = rows.select(F.when(F.col("h") % STRAY == 0, short).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= MIN_CHARS).groupBy("word").agg(F.count("*").alias("n"))


def meeting_key(word: Column, own: Column, longer: Column, low: Column, high: Column) -> Column:
    """A name for all of ``word`` but its open part [low, high), counted in the longer word's code points."""
    behind = high + own - longer
    return F.xxhash64(longer, low, high, F.substr(word, F.lit(1), low), F.substr(word, behind + 1, own))


def halves(rows: DataFrame) -> DataFrame:
    """Every open part cut in two, with the key of what is outside."""
    middle = F.expr("(low + high) div 2").cast("int")
    cut = rows.select("word", "n", "own", "longer", F.explode(F.array(
        F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))).alias("part"))
    cut = cut.select("word", "n", "own", "longer", "part.low", "part.high").where("low < high")
    return cut.withColumn("key", meeting_key(*[F.col(c) for c in ("word", "own", "longer", "low", "high")]))


def verified(rows: DataFrame) -> DataFrame:
    """Near pairs among the words that share a key: a, n_a, b, n_b; every pair once."""
    a = rows.where("own = longer").select("key", "high", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = rows.select("key", (F.col("own") == F.col("longer")).alias("same"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = a.join(b, "key").where(~F.col("same") | (F.col("a") < F.col("b")))
    first_inside = F.substr("a", F.lit(1), F.col("high")) != F.substr("b", F.lit(1), F.col("high"))
    return met.where(first_inside & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """Every unordered pair of near words once: a, n_a, b, n_b."""
    own = F.char_length("word").cast("int")
    rows = words.select("word", "n", own.alias("own"), F.explode(F.array(own, own + 1)).alias("longer"))
    rows = rows.select("word", "n", "own", "longer", F.lit(0).alias("low"), F.col("longer").alias("high"))
    pairs = None
    while True:
        parts = halves(rows)
        sizes = parts.groupBy("key").agg(
            F.count("*").alias("size"), F.max(F.col("own") == F.col("longer")).alias("led"), F.max(F.col("high") - F.col("low")).alias("open"))
        sizes = stored(sizes.where("size > 1 AND led").select("key", ((F.col("size") > hot) & (F.col("open") > 1)).alias("hot")))
        # A sieve may let other keys pass: a word too many to meet, or a group cut although it need not be. Both do no harm.
        parts = marked(parts, sieve(sizes.where("NOT hot").select("key")), [F.col("key")], "meets")
        parts = marked(parts, sieve(sizes.where("hot").select("key")), [F.col("key")], "crowd")
        parts = parts.withColumn("crowd", F.col("crowd") & (F.col("high") - F.col("low") > 1))
        found = verified(parts.where("meets AND NOT crowd"))
        pairs = found if pairs is None else pairs.unionByName(found)
        if sizes.where("hot").isEmpty():
            return pairs
        rows = stored(parts.where("crowd").select("word", "n", "own", "longer", "low", "high"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` has word and form, a forest: word and root. Paths double each round."""
    hops = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        after = hops.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = stored(hops.join(after, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        hops = further.select("word", "root")
        if further.where("moved").isEmpty():
            return hops


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = stored(counted_words(docs, doc_id, text).where(F.col("n") >= MIN_COUNT))
    pairs = near_pairs(words, hot)
    ends = F.array(*[F.struct(F.col(x).alias("word"), F.struct((-F.col(f"n_{y}")).alias("less"), F.col(y).alias("near")).alias("best")) for x, y in ("ab", "ba")])
    best = pairs.select(F.explode(ends).alias("end")).groupBy(F.col("end.word").alias("word")).agg(
        F.count("*").alias("n_near"), F.min("end.best").alias("best"))
    is_form = -F.col("best.less") >= F.col("n") * FACTOR
    judged = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
