"""Portfolio weights, allocations, value series, and news feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_close_and_move(sessions: DataFrame) -> DataFrame:
    """Last close and last session's move (0 if none) of each instrument."""
    x = sessions.groupBy("cod").agg(F.max(F.struct("idx", "d", "last", "ret")).alias("x"))
    return x.select("cod", F.col("x.d").alias("d"), F.col("x.last").alias("close"), F.coalesce("x.ret", F.lit(0.0)).alias("move"))


def values(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Positions with the value of each; positions without a price go. prices has (cod, close)."""
    return positions.join(prices, positions["ticker"] == prices["cod"]).select("ticker", "qty", "close", (F.col("qty") * F.col("close")).alias("value"))


def largest_remainder(rows: DataFrame, *, value: str = "value", key: str = "ticker", units: int = 1000) -> DataFrame:
    """Weights in whole units of the total that sum to it exactly: floors, and one more to the largest remainders.

    No more than `units` rows can get one more, so only the top `units` remainders are numbered, after a distributed top-k.
    """
    total = rows.agg(F.sum(value).alias("_total"))  # one row
    x = rows.crossJoin(F.broadcast(total)).withColumn("_u", F.col(value) / F.col("_total") * units).withColumn("_f", F.floor("_u"))
    rest = x.agg((F.lit(units) - F.sum("_f")).alias("_rest"))  # one row
    best = x.select(key, F.round(F.col("_u") - F.col("_f"), 9).alias("_r")).orderBy(F.desc("_r"), key).limit(units)
    best = best.withColumn("_p", F.row_number().over(Window.orderBy(F.desc("_r"), key))).crossJoin(F.broadcast(rest)).where(F.col("_p") <= F.col("_rest"))
    more = best.select(key, F.lit(1).alias("_more"))
    return x.join(more, key, "left").withColumn("units", (F.col("_f") + F.coalesce("_more", F.lit(0))).cast("long")).select(*rows.columns, "units")


def bucketed(rows: DataFrame, label: str, keep: int, *, most: int | None = None, value: str = "value", other: str = "other") -> DataFrame:
    """Sums by label, the largest `keep` labels by name and the rest as one; all of them if there are no more than `most`."""
    sums = rows.groupBy(label).agg(F.sum(value).alias(value))
    most = most if most is not None else keep
    first = sums.orderBy(F.desc(value), label).limit(max(keep, most) + 1)  # a distributed top-k
    first = first.withColumn("_k", F.row_number().over(Window.orderBy(F.desc(value), label))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    named = first.where((F.col("_k") <= keep) | (F.col("_n") <= most)).select(label, F.lit(True).alias("_named"))
    out = sums.join(F.broadcast(named), label, "left")  # at most `most` labels
    return out.groupBy(F.when(F.col("_named"), F.col(label)).otherwise(other).alias(label)).agg(F.sum(value).alias(value))


def numbered(calendar: DataFrame) -> DataFrame:
    """(d, k): the days of a calendar from 1. One row for each trading day, some 250 a year, so one window over all of them is small."""
    return calendar.select("d").distinct().withColumn("k", F.row_number().over(Window.orderBy("d")))


def align(sessions: DataFrame, calendar: DataFrame, *, lead: bool) -> DataFrame:
    """(cod, d, close) on every calendar day, carried forward; days before the first close take it if `lead`, else stay null.

    Each session stands for the days up to the next one, so it is spread over its interval of day numbers: no grid of
    codes and days is joined or sorted. Every session's day is in the calendar.
    """
    days = numbered(calendar)
    n = days.agg(F.max("k").alias("n"))  # one row
    w = Window.partitionBy("cod").orderBy("k")
    x = sessions.select("cod", "d", F.col("last").alias("close")).join(F.broadcast(days), "d").crossJoin(F.broadcast(n))  # the calendar, as above
    x = x.withColumns({"_to": F.coalesce(F.lead("k").over(w) - 1, F.col("n")), "_first": F.lag("k").over(w).isNull()})
    upto = [F.struct(F.when(F.lit(lead), F.col("close")).alias("close"), F.lit(1).alias("a"), (F.col("k") - 1).alias("z")), F.struct("close", F.col("k").alias("a"), F.col("_to").alias("z"))]
    parts = F.filter(F.when(F.col("_first"), F.array(*upto)).otherwise(F.array(upto[1])), lambda p: p["z"] >= p["a"])
    x = x.select("cod", F.inline(parts)).select("cod", "close", F.explode(F.sequence("a", "z")).alias("k"))
    return x.join(F.broadcast(days), "k").select("cod", "d", "close")


def value_series(positions: DataFrame, sessions: DataFrame, ranges: dict[str, int | None]) -> DataFrame:
    """(range, d, value, change, pct): the value of all positions on the last n days of each range (None: all of them), and its change over the range.

    The value is a running sum of changes: a position counts at its first close from the start and moves by its quantity
    times each change of close, so that days are summed before anything is carried forward and no grid of codes and
    days arises. Positions meet sessions first. Values are decimals, so that the running sum is exact; positions without a session do not count.
    sessions has cod, d, last of all instruments, whose days are the calendar.
    """
    held = sessions.select("cod", "d", "last").join(positions.select(F.col("ticker").alias("cod"), "qty"), "cod")
    worth = (F.col("qty") * F.col("last")).cast("decimal(28,8)")
    w = Window.partitionBy("cod").orderBy("d")
    moved = held.select("cod", "d", worth.alias("v")).select("d", F.lag("v").over(w).alias("before"), "v")
    start = moved.where("before is null").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("_start"))  # one row
    by_day = moved.where("before is not null").groupBy("d").agg(F.sum(F.col("v") - F.col("before")).alias("delta"))
    days = sessions.select("d").distinct().join(by_day, "d", "left").crossJoin(F.broadcast(start))
    run = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # one row for each trading day
    values = days.select("d", (F.col("_start") + F.coalesce(F.sum("delta").over(run), F.lit(0))).alias("value"), F.row_number().over(Window.orderBy(F.desc("d"))).alias("_back"))
    of = F.array(*[F.struct(F.lit(name).alias("range"), F.lit(n or 2**31 - 1).alias("n")) for name, n in ranges.items()])
    x = values.select("*", F.explode(of).alias("r")).where("_back <= r.n").select("r.range", "d", "value")
    ends = x.groupBy("range").agg((F.max_by("value", "d") - F.min_by("value", "d")).alias("change"), F.min_by("value", "d").alias("_first"), F.max_by("value", "d").alias("_last"))
    ratio = F.try_divide(F.col("_last").cast("double"), F.col("_first").cast("double")) - 1
    return x.join(F.broadcast(ends), "range").select("range", "d", "value", "change", F.coalesce(ratio * 100, F.lit(0.0)).alias("pct"))  # a row for each range


def overlay(*layers: DataFrame, key: str = "id") -> DataFrame:
    """Rows by key with each column from the first layer that has it."""
    out = layers[0]
    for layer in layers[1:]:
        cols = [c for c in out.columns if c != key]
        out = out.alias("a").join(layer.alias("b"), key, "full").select(key, *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in cols])
    return out


def first_of(main: DataFrame, rest: DataFrame, key: str) -> DataFrame:
    """main and the rows of rest whose key main lacks."""
    return main.unionByName(rest.join(main.select(key), key, "left_anti"))


def signal(rows: DataFrame, *, least: float = 0.60, n: int = 10) -> DataFrame:
    """Mean of sign x strength x similarity by ticker over similar stories; the n largest by size."""
    x = rows.where(F.col("sim") >= least).groupBy("ticker").agg(F.avg(F.col("sign") * F.col("strength") * F.col("sim")).alias("signal"))
    return x.orderBy(F.desc(F.round(F.abs("signal"), 9)), "ticker").limit(n)


def company_columns(days: DataFrame) -> DataFrame:
    """One row for each company with parallel arrays by day: d, close (4 places), volume, move_pct and z (2 places).

    Closes are rounded to eight places before, so that the last bits of a quotient never decide a tie. days has cod, d, last, qty, ret, z; a company has some 250 days a year.
    """
    x = days.groupBy("cod").agg(F.sort_array(F.collect_list(F.struct("d", "last", "qty", "ret", "z"))).alias("x"))
    col = lambda f, name: F.transform("x", f).alias(name)
    return x.select(
        "cod", col(lambda r: F.date_format(r["d"], "yyyy-MM-dd"), "d"), col(lambda r: F.round(F.round(r["last"], 8), 4), "close"), col(lambda r: F.round(r["qty"], 0), "volume"), col(lambda r: F.round(r["ret"] * 100, 2), "move_pct"), col(lambda r: F.round(r["z"], 2), "z"))


def integrity(stories: DataFrame, details: DataFrame, companies: DataFrame, statuses: list[str], manifest: dict[str, int] | None = None) -> DataFrame:
    """(rule, id): every breach of a bundle's contract, from one pass over its stories and one over its companies.

    stories has id, cod, status, has_series, z; details id, status, series (an array or null); companies cod, n_stories,
    counts (status -> number), has_prices, prices (a struct of parallel arrays or null). The rules are an array of those
    that a row breaks, which is taken apart. manifest holds the counts that it claims of stories and companies.
    """
    finite = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))
    known = lambda c: F.col(c).isin(*statuses)

    def broken(rules: dict[str, Column]) -> Column:
        return F.explode(F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(rule)) for rule, cond in rules.items()])))

    s = stories.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("cod", "status", "has_series", "z")).alias("s"))
    d = details.groupBy("id").agg(F.min(F.struct("status", "series")).alias("d"), F.count(F.lit(1)).alias("n_d"))
    c = companies.select(F.col("cod").alias("_cod"), F.lit(True).alias("_company"))
    x = s.join(d, "id", "full").select("id", "n", "n_d", "s", "d", F.col("s.cod").alias("_cod")).join(c, "_cod", "left")
    both = F.col("s").isNotNull() & F.col("d").isNotNull()
    out = x.select("id", broken({
        "duplicate_story": F.col("n") > 1, "duplicate_detail": F.col("n_d") > 1, "story_without_detail": F.col("d").isNull(), "detail_without_story": F.col("s").isNull(),
        "story_without_company": F.col("s").isNotNull() & F.col("_company").isNull(), "unknown_status": F.col("s").isNotNull() & ~F.coalesce(known("s.status"), F.lit(False)), "status_differs": both & ~F.col("s.status").eqNullSafe(F.col("d.status")),
        "series_flag": both & (F.col("s.has_series") != F.col("d.series").isNotNull()), "series_empty": F.size("d.series") == 0, "not_finite": ~finite(F.col("s.z")) | F.exists("d.series", lambda v: ~finite(v)),
    }).alias("rule"))
    told = stories.groupBy(F.col("cod").alias("_cod")).agg(F.count(F.lit(1)).alias("_n"))
    arrays = [f.name for f in companies.schema["prices"].dataType]
    y = companies.join(told, F.col("cod") == F.col("_cod"), "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    numbers = [f.name for f in companies.schema["prices"].dataType if f.dataType.elementType.typeName() == "double"]
    out2 = y.select(F.col("cod").alias("id"), broken({
        "company_count": F.col("n_stories") != F.col("_n"), "company_summary": F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, v: a + v) != F.col("n_stories"), "unknown_summary_status": F.exists(F.map_keys("counts"), lambda k: ~k.isin(*statuses)),
        "price_flag": F.col("has_prices") != F.col("prices").isNotNull(), "array_lengths": F.size(F.array_distinct(F.array(*[F.size(f"prices.{a}") for a in arrays]))) > 1,
        "not_finite": F.exists(F.flatten(F.array(*[F.col(f"prices.{a}") for a in numbers])), lambda v: ~finite(v)),
    }).alias("rule"))
    out = out.unionByName(out2)
    for name, table in (("stories", stories), ("companies", companies)):
        if manifest and name in manifest:
            wrong = table.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != manifest[name])  # one row
            out = out.unionByName(wrong.select(F.lit(name).alias("id"), F.lit("manifest_count").alias("rule")))
    return out.select("rule", "id")
