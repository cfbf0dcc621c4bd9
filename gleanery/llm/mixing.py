"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are shuffled by a seed and cut into blocks. Time runs in periods: in one period a source of
weight w may send w blocks. Within a period of T slots, a source that sends c blocks gets release times
floor(j T / c) and deadlines ceil((j + 1) T / c) for its blocks j = 0 .. c - 1; in each slot the released block
with the earliest deadline goes (ties to the source that comes first by name). This earliest-deadline-first
schedule is feasible, so at every slot every source is less than one block from its share of the period,
and exactly on it at the period's end. A source that runs out sends what it has left in its last
period; later periods share the slots among the others. Every row is kept, exactly once.

Which periods look alike is known from the sources' sizes alone, so one period of each kind is scheduled
(at most two kinds per source) and all rows find their slot by a join with that small table.
Its size is bounded by the target weights: sources x sum of weights slots for each kind.

Defined results: null sources form a source of their own; sources without a target get weight
``other``; rows that repeat an id are ordered by a hash of the whole row. Empty tables stay empty. Weights
are integers >= 1. The last block of a source may be short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.ranking import group_key, hash_range, ranges_for, ranked, shuffle_key
from gleanery.llm.shared import fresh, quoted

#: Blocks that a source sends per period; every other source sends OTHER.
WEIGHTS: dict[str, int] = {"src0": 4, "src1": 2, "src2": 2}
OTHER = 1
BLOCK_ROWS, SEED = 16, 5


def period(counts: Column) -> Column:
    """The source index sent in each slot of a period in which source i sends ``counts[i]`` blocks."""
    slots = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c)
    start = F.struct(
        F.transform(counts, lambda c: c * 0).alias("sent"), F.array().cast("array<int>").alias("out"), counts.alias("counts"),
        slots.alias("slots"),
    )

    def send(acc: Column, t: Column) -> Column:
        total = acc["slots"]

        def job(sent: Column, i: Column) -> Column:
            count = F.get(acc["counts"], i)
            released = (sent < count) & (sent * total < (t + 1) * count)
            return F.when(released, F.struct(F.ceil((sent + 1) * total / count).alias("due"), i.alias("i")))

        first = F.array_min(F.filter(F.transform(acc["sent"], job), lambda x: x.isNotNull()))["i"]
        return F.struct(
            F.transform(acc["sent"], lambda s, i: s + (i == first).cast("bigint")).alias("sent"),
            F.concat(acc["out"], F.array(first)).alias("out"), acc["counts"].alias("counts"), total.alias("slots"),
        )

    steps = F.when(slots > 0, F.sequence(F.lit(0).cast("bigint"), slots - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, send)["out"]


def schedule(sizes: DataFrame, weights: dict[str, int], other: int) -> DataFrame:
    """One row per kind of period, source and block sent: first, until, source, weight, sent, slot, slots, offset.

    ``sizes`` has one row per source: source (group key), blocks. A kind covers the periods first <= m < until;
    ``offset`` is the number of blocks that all sources send before period ``first``.
    """
    named = F.lit(other)
    for name, weight in weights.items():
        named = F.when(F.col("source") == F.lit(f"={name}"), weight).otherwise(named)
    sources = sizes.select("source", "blocks", named.cast("bigint").alias("weight"))
    table = sources.agg(F.array_sort(F.collect_list(F.struct("source", "blocks", "weight"))).alias("s"))
    last = F.transform("s", lambda x: F.floor(x["blocks"] / x["weight"]))
    starts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), last, F.transform(last, lambda m: m + 1))))
    kinds = table.select("s", starts.alias("starts")).select("s", "starts", F.posexplode("starts").alias("k", "first"))
    sent = F.transform("s", lambda x: F.greatest(
        F.lit(0).cast("bigint"), F.least(x["weight"], x["blocks"] - F.col("first") * x["weight"])))
    before = F.aggregate(
        F.transform("s", lambda x: F.least(x["blocks"], F.col("first") * x["weight"])), F.lit(0).cast("bigint"), lambda a, b: a + b)
    kinds = kinds.select("s", "first", F.get("starts", F.col("k") + 1).alias("until"), before.alias("offset"), sent.alias("counts"))
    slots = kinds.select("*", period(F.col("counts")).alias("order")).select(
        "s", "first", "until", "offset", F.size("order").cast("bigint").alias("slots"), F.posexplode("order").alias("slot", "i"))
    nth = Window.partitionBy("first", "i").orderBy("slot")
    return slots.select(
        "first", "until", "offset", "slots", F.col("slot").cast("bigint").alias("slot"),
        F.get("s", F.col("i"))["source"].alias("source"), F.get("s", F.col("i"))["weight"].alias("weight"),
        (F.row_number().over(nth) - 1).cast("bigint").alias("sent"),
    )


def mixed(docs: DataFrame, weights: dict[str, int] = WEIGHTS, other: int = OTHER, block_rows: int = BLOCK_ROWS,
          seed: int = SEED, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, block, mix_block, mix_row, in the order (mix_block, mix_row)."""
    rows = docs.select(
        quoted(doc_id).alias("doc_id"), group_key(quoted(source)).alias("key"), quoted(source).alias("source"),
        F.xxhash64(*[quoted(c) for c in docs.columns]).alias("content"), shuffle_key(quoted(doc_id), seed).alias("shuffled"),
    )
    return placed(rows, docs.count(), weights, other, block_rows).select(
        "doc_id", "source", "block", "mix_block", F.col("mix_row").cast("int").alias("mix_row"))


def placed(rows: DataFrame, n: int, weights: dict[str, int], other: int, block_rows: int) -> DataFrame:
    """``rows`` (with key, shuffled, doc_id, content) and their block, mix_block and mix_row."""
    rows = rows.withColumn("cell", hash_range(F.col("shuffled"), ranges_for(n)))
    rows = ranked(rows, ["key"], "cell", ["shuffled", "doc_id", "content"], "rank", "in_source")
    rows = rows.withColumn("block", F.floor(F.col("rank") / block_rows))
    sizes = rows.groupBy(F.col("key").alias("source")).agg(F.ceil(F.max("in_source") / block_rows).alias("blocks"))
    plan = schedule(sizes, weights, other).select(
        F.col("source").alias("plan_key"), "first", "until", "offset", "slots", "slot", "weight", "sent")
    # Sources and weights bound this table (see above), not the rows.
    wide = F.broadcast(plan.groupBy("plan_key").agg(
        F.max("weight").alias("weight"),
        F.sort_array(F.collect_list(F.struct("first", "sent", "until", "offset", "slots", "slot"))).alias("plan")))
    joined = rows.join(wide, F.col("key") == F.col("plan_key"))
    m, sent = F.floor(F.col("block") / F.col("weight")), F.col("block") % F.col("weight")
    joined = joined.withColumns({"m": m, "sent": sent})
    slot = F.get(F.filter("plan", lambda p: (p["first"] <= F.col("m")) & (F.col("m") < F.coalesce(p["until"], F.col("m") + 1))
                          & (p["sent"] == F.col("sent"))), F.lit(0))
    joined = joined.withColumn("at", slot).drop("plan")
    return joined.withColumns({
        "mix_block": F.col("at.offset") + (F.col("m") - F.col("at.first")) * F.col("at.slots") + F.col("at.slot"),
        "mix_row": F.col("rank") % block_rows,
    })


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """``docs``, all rows and columns, and their mix_block and mix_row, sorted by them.

    Readers pack files in any order, so that the two columns, not the order of the files, carry the decision.
    """
    settings = {"weights": WEIGHTS, "other": OTHER, "block_rows": BLOCK_ROWS, "seed": SEED} | options
    whole, *placing = fresh(docs, "_row", "mix_block", "mix_row")
    rows = docs.select(
        quoted(doc_id).alias("doc_id"), group_key(quoted(source)).alias("key"),
        shuffle_key(quoted(doc_id), settings["seed"]).alias("shuffled"),
        F.xxhash64(*[quoted(c) for c in docs.columns]).alias("content"),
    )
    order = placed(rows, docs.count(), settings["weights"], settings["other"], settings["block_rows"])
    # Rows that agree in id and content are interchangeable: they share the first of their places.
    order = order.groupBy(F.col("doc_id").alias("_id"), F.col("content").alias("_content")).agg(
        F.min(F.struct("mix_block", "mix_row")).alias("_place"))
    keyed = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias(whole),
                        quoted(doc_id).alias("_id_"), F.xxhash64(*[quoted(c) for c in docs.columns]).alias("_content_"))
    joined = keyed.join(order, F.col("_id_").eqNullSafe(F.col("_id")) & (F.col("_content_") == F.col("_content")))
    return joined.orderBy("_place").select(
        *[F.col(whole).getField(c).alias(c) for c in docs.columns],
        F.col("_place.mix_block").alias(placing[0]), F.col("_place.mix_row").cast("int").alias(placing[1]))
