"""Mixing sources to target weights: a Pfair schedule of source blocks, earliest deadline first. DataFrame functions only.

Weights are rounded to quanta q of a resolution R = 2^36, so that over T slots of n sources the rounding moves a share by
less than T (n + 2) / R blocks. Block k of a source has release floor(k R / q) and deadline ceil((k + 1) R / q); each slot
takes, among the released blocks, the one with the earliest deadline, and a slot for which no block is released stays empty.
Windows sum to one processor, so earliest-deadline-first meets them all and no source is ever a whole block away from its
share. The real blocks are folded one after the other by one expression over the table of sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, unboxed, written

#: Quanta that the weights of all sources sum to.
RESOLUTION = 1 << 36


def quanta(weights: DataFrame, period: int) -> DataFrame:
    """(source, q): whole quanta that sum to the period, at least one each, by largest remainder."""
    total = Window.partitionBy(F.lit(0))  # a row for each source
    shares = weights.where("weight > 0").withColumn("n", F.count(F.lit(1)).over(total))
    exact = (F.lit(period) - F.col("n")) * F.col("weight") / F.sum("weight").over(total)
    shares = shares.withColumn("exact", exact).withColumn("q", F.floor("exact") + 1)
    left = F.lit(period) - F.sum("q").over(total)
    place = F.row_number().over(total.orderBy((F.col("exact") - F.floor("exact")).desc(), "source"))
    return shares.withColumn("left", left).select("source", (F.col("q") + (place <= F.col("left")).cast("long")).alias("q"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def block_slots(shares: DataFrame, resolution: int, stretch: int = 1024) -> DataFrame:
    """(source, block_no, release, deadline, slot) for each real block of (source, q, n_blocks).

    Each step places one block, so empty slots cost nothing. Steps are folded in stretches only to keep appended arrays short.
    """
    whole = F.lit(resolution)

    def head(i: Column, k: Column, q: Column, n: Column) -> Column:
        due = F.call_function("div", (k + 1) * whole + q - 1, q)
        return F.struct(due.alias("d"), i.alias("i"), F.call_function("div", k * whole, q).alias("r"), k.alias("k"), q.alias("q"), n.alias("n"))

    def place(state: Column, t: Column) -> Column:
        best = F.array_min(F.filter(state["heads"], lambda h: h["r"] <= t))

        def after(b: Column) -> Column:
            moved = F.transform(state["heads"], lambda h: F.when(h["i"] == b["i"], head(h["i"], h["k"] + 1, h["q"], h["n"])).otherwise(h))
            placed = F.struct(b["i"].alias("i"), b["k"].alias("block_no"), b["r"].alias("release"), b["d"].alias("deadline"), t.alias("slot"))
            return F.struct(F.filter(moved, lambda h: h["k"] < h["n"]).alias("heads"), (t + 1).alias("t"), F.concat(state["out"], F.array(placed)).alias("out"))

        return let(best, after)

    def step(state: Column, _: Column) -> Column:
        return let(F.greatest(state["t"], F.array_min(F.transform(state["heads"], lambda h: h["r"]))), lambda t: place(state, t))

    kind = "array<struct<i:int,block_no:bigint,release:bigint,deadline:bigint,slot:bigint>>"

    def fold(state: Column, done: Column) -> Column:
        steps = F.sequence(F.lit(1), F.least(F.lit(stretch), F.col("total") - done).cast("int"))
        start = F.struct(state["heads"].alias("heads"), state["t"].alias("t"), F.array().cast(kind).alias("out"))
        return let(F.aggregate(steps, start, step), lambda x: F.struct(x["heads"].alias("heads"), x["t"].alias("t"), F.concat(state["out"], F.array(x["out"])).alias("out")))

    q, n = F.col("q").cast("long"), F.col("n_blocks").cast("long")
    one = shares.where("n_blocks > 0").agg(F.sort_array(F.collect_list(F.struct("source", q.alias("q"), n.alias("n")))).alias("s"), F.sum(n).alias("total")).where("total > 0")
    heads = F.transform("s", lambda x, i: head(i, F.lit(0).cast("long"), x["q"], x["n"]))
    start = F.struct(heads.alias("heads"), F.lit(0).cast("long").alias("t"), F.array().cast(f"array<{kind}>").alias("out"))
    slots = one.select("s", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(stretch).cast("long")), start, fold, lambda x: x["out"]).alias("out"))
    rows = slots.select("s", F.explode("out").alias("out")).select("s", F.explode("out").alias("x"))
    return rows.select(F.get("s", F.col("x.i"))["source"].alias("source"), "x.block_no", "x.release", "x.deadline", "x.slot")


def period_slots(shares: DataFrame, period: int) -> DataFrame:
    """(source, q, slots): for each source of q quanta the slots of its first q blocks."""
    slots = block_slots(shares.withColumn("n_blocks", F.col("q")), period).groupBy("source").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    return shares.join(slots, "source").select("source", "q", "slots")


def default_weights(counts: DataFrame) -> DataFrame:
    """Weights by the square root of a source's rows, which lifts small sources."""
    return counts.select("source", F.sqrt(F.col("rows").cast("double")).alias("weight"))


ADDED = ["block_no", "release", "deadline", "slot", "place"]


def schedule(docs: DataFrame, weights: DataFrame | None = None, *, source: str = "source", id: str = "doc_id", block: int = 16, period: int = 1024, paths: list[str] | None = None) -> DataFrame:
    """docs plus block_no, release, deadline, slot and place: row (slot, place) is where a document stands in the mix.

    A source's documents come in the order of a hash of their id, in blocks of `block` documents. `slot` is the block's
    slot in the endless schedule; once a source has no more blocks its slots stay empty and the others go on in their
    proportions, so every row is kept. weights has (source, weight); without it, square roots of the row counts. A null
    source is a source of its own ('' in the weights), a source without a weight comes last (null slot). Repeated rows and
    ties keep their rows; an empty table gives an empty table; an extra column named like an added one gives way to it. `period` blocks are folded in one stretch; it changes no slot.

    Numbering inside a source never brings a source together: rows are numbered within hash buckets of a few thousand
    rows, and bucket totals give each bucket its offset.
    """
    # rows without an id are told apart by their place in the input, so that they do not share one bucket
    spread = F.when(F.col(id).isNull(), F.monotonically_increasing_id())
    rows = boxed(docs, F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_s"), F.col(id).alias("_id"), F.xxhash64(F.coalesce(F.col(id).cast("string"), F.lit("")), spread).alias("_h"))
    n = docs.count()
    rows = rows.withColumn("_b", F.pmod("_h", F.lit(max(1, n // 4096))))
    totals = written(rows.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("n")), paths)
    offsets = totals.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    sizes = totals.groupBy(F.col("_s").alias("source")).agg(F.sum("n").alias("rows"))
    weights = weights.select(F.coalesce("source", F.lit("")).alias("source"), "weight") if weights is not None else default_weights(sizes)
    shares = quanta(weights, RESOLUTION).join(sizes.withColumn("n_blocks", F.ceil(F.col("rows") / block)), "source")
    plan = written(block_slots(shares, RESOLUTION, period), paths)
    number = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", "_id"))
    out = rows.withColumn("_n", number).join(written(offsets, paths), ["_s", "_b"]).withColumn("_n", F.col("_n") + F.col("before") - 1)
    out = out.withColumns({"block_no": F.floor(F.col("_n") / block), "place": (F.col("_n") % block).cast("int")})
    out = out.join(plan.withColumnRenamed("source", "_s"), ["_s", "block_no"], "left")
    return unboxed(out, docs.columns, *ADDED)


def in_file_order(docs: DataFrame) -> DataFrame:
    """docs as read from Parquet files plus position: a row's number, from 0, in the order of the files' names and rows."""
    rows = boxed(docs, F.col("_metadata.file_name").alias("_f"), F.col("_metadata.row_index").alias("_i"))
    sizes = rows.groupBy("_f").agg(F.count(F.lit(1)).alias("n"))  # a row for each file
    before = F.coalesce(F.sum("n").over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_f", before.alias("_before"))
    return unboxed(rows.join(F.broadcast(starts), "_f").withColumn("position", F.col("_before") + F.col("_i")), docs.columns, "position")


def op8(docs: DataFrame) -> DataFrame:
    """The query's table: the places of `schedule` with its default weights; edge cases as stated there."""
    out = schedule(docs.select("doc_id", "source"))
    return out.select("doc_id", "source", "block_no", "release", "deadline", "slot", "place")
