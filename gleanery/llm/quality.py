"""Quality rules with risk-controlled thresholds.

Every rule rejects a document whose measure exceeds a cutoff. Cutoffs are chosen per stratum (language)
from a fixed grid, on labelled good documents that were set apart for it: going from the loosest cutoff to stricter ones, a
cutoff is accepted while the exact binomial test rejects "this rule rejects ALPHA or more of the good
documents" at level DELTA / (rules x strata). Testing in a fixed order needs no further correction along
the grid; the division corrects for all rules and strata (Bonferroni). So, with probability 1 - DELTA, no
rule in any stratum rejects more than ALPHA of the good documents. A stratum with too few labels gets no cutoff.

Defined results: a null text has no words and fails the base rules; a null language is a stratum of its
own; null labels are ignored and a document with conflicting labels counts as bad; repeated rows are
judged alike. An empty table, or no labels, gives base verdicts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.shared import quoted, saved

ALPHA, DELTA = 0.01, 0.05
BLANK, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Cutoffs of each measure, from loose to strict.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (2.0, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1),
    "dup_line_share": (0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeat_share": (0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06),
    "mean_word_chars": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0),
    "upper_share": (0.95, 0.9, 0.8, 0.7, 0.5, 0.3, 0.2),
}


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Counts of every whole text; one row per row of ``docs``. Texts stay where they are read."""
    body = F.coalesce(quoted(text), F.lit(""))
    split = docs.select(
        quoted(doc_id).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), quoted(stratum)), F.lit("")).alias("stratum"),
        F.filter(F.split(body, BLANK), lambda w: w != "").alias("words"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD)).alias("lines"),
        F.length(F.regexp_replace(body, BLANK, "")).alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).alias("n_symbols"),
        (F.length(body) - F.length(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
    )
    n, words = F.size("words"), F.col("words")
    starts = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.when(n >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(WINDOW)))))
    hashed = split.select("*", hashes.alias("hashes"))
    # A text whose windows all hash apart repeats none; only the others compare the windows themselves.
    suspect = F.size(F.array_distinct("hashes")) < F.size("hashes")
    windows = F.transform(starts, lambda i: F.struct(
        F.array_join(F.slice(words, i + 1, F.lit(WINDOW)), " ").alias("w"), i.alias("i")))
    ordered = hashed.select("*", F.when(suspect, F.array_sort(windows)).alias("ordered")).drop("hashes")
    at = F.col("ordered")

    def twice(x: Column, j: Column) -> Column:
        before, after = F.get(at, j - 1)["w"], F.get(at, j + 1)["w"]
        return F.coalesce(x["w"] == before, F.lit(False)) | F.coalesce(x["w"] == after, F.lit(False))

    found = ordered.select("*", F.sort_array(F.transform(F.filter(at, twice), lambda x: x["i"])).alias("found"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    covered = F.aggregate("found", start, lambda acc, p: F.struct(
        (p + WINDOW).alias("end"), (acc["total"] + p + WINDOW - F.greatest(p, acc["end"])).alias("total")))
    lines = F.col("lines")
    return found.select(
        "doc_id", "stratum", n.cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered["total"], F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"), F.col("n_upper").cast("long").alias("n_upper"),
    )


def rated(counts: DataFrame) -> DataFrame:
    """The base verdict and the measures of the rules."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return counts.select(
        "*",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))).alias("upper_share"),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed term by term in logarithms."""
    odds = F.lit(p / (1 - p))
    first = F.struct((n * F.log(F.lit(1 - p))).alias("term"), F.exp(n * F.log(F.lit(1 - p))).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * odds)
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, first, add)["total"]


def thresholds(rates: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality",
               alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per stratum with a usable cutoff: one column of cutoffs for each rule (null: the rule rejects nothing).

    Calibrates on the good labelled documents that pass the base rules.
    """
    good = (
        labels.where(quoted(quality).isNotNull()).groupBy(quoted(doc_id).alias("doc_id"))
        .agg(F.min(quoted(quality)).alias("quality")).where("quality = 1").select("doc_id")
    )
    held = rates.where(~F.col("base_failed")).join(good, "doc_id")
    over = {f"{rule}_{i}": F.count_if(F.col(rule) > cut) for rule, grid in GRIDS.items() for i, cut in enumerate(grid)}
    counted = held.groupBy("stratum").agg(F.count("*").alias("n"), *[c.alias(name) for name, c in over.items()])
    counted = counted.withColumn("strata", F.count("*").over(Window.partitionBy()))  # one row per stratum
    level = F.lit(delta) / (F.lit(len(GRIDS)) * F.col("strata"))
    chosen = {}
    for rule, grid in GRIDS.items():
        passes = []
        for i in range(len(grid)):
            k = F.col(f"{rule}_{i}")
            # From k >= alpha * n on the tail is above a half or close to it: no need to sum it.
            passes.append(F.when(k >= F.col("n") * alpha, False).otherwise(binomial_tail(k, F.col("n"), alpha) <= level))
        first_failure = F.array_position(F.array(*passes), F.lit(False))
        cuts = F.array(*[F.lit(c) for c in grid])
        accepted = F.when(first_failure == 0, len(grid)).otherwise(first_failure - 1).cast("int")
        chosen[rule] = F.when(accepted > 0, F.element_at(cuts, F.greatest(accepted, F.lit(1))))
    out = counted.select("stratum", *[c.alias(f"{rule}_cut") for rule, c in chosen.items()])
    return out.where(F.coalesce(*[F.col(f"{rule}_cut") for rule in GRIDS]).isNotNull())


def quality_verdicts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     stratum: str = "lang") -> DataFrame:
    """One row per row of ``docs``: counts, base_failed, kept, and the first rule that rejected it."""
    rates = saved(rated(measures(docs, doc_id, text, stratum)))  # read twice: to calibrate and to judge
    judged = rates.join(thresholds(rates, labels), "stratum", "left")
    broken = [F.when(F.col(rule) > F.col(f"{rule}_cut"), F.lit(rule)) for rule in GRIDS]
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(*broken).isNull()).alias("kept"),
        F.when(~F.col("base_failed"), F.coalesce(*broken)).alias("rejected_by"),
    )
