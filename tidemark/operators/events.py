"""Verdicts on articles, first articles, and lift over chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ["NO_REACTION", "ALREADY_IN_PRICE", "PARTLY_IN_PRICE", "MOSTLY_AT_OPEN", "REACTED", "DELAYED"]
#: Slots in their order, with the chance that each is held against.
SLOTS = [("day_before", "a"), ("reaction", "b"), ("same_day_pre_open", "b"), ("same_day_in_session", "b"), ("same_day_after_close", "b"), *((f"later_{k}", "b") for k in range(1, 6))]


def argmax(value: Column, *carried: str, when: Column | None = None) -> Column:
    """The struct (v, -day number, carried columns) of the largest value, the earliest day on ties; null if none qualifies."""
    key = F.struct(value.alias("v"), (-F.unix_date("d")).alias("neg_d"), *carried)
    on = value.isNotNull() if when is None else when & value.isNotNull()
    return F.max(F.when(on, key))


def verdicts(tape: DataFrame, *, cut: float = 2.0, majority: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each article: six-way status, its peak and largest session, the unusual sessions in date order.

    One aggregation by article; argmax ties go to the earliest session. Peak and largest session bring the tape's `carry` columns too.
    """
    size = F.abs("z")
    odd = F.coalesce(F.col("unusual"), F.lit(False)) & (size >= cut)
    carried = ["d", "timing", "z", "ret", "is_reaction", "open_share", "closed_before", "retained", *carry]
    session = F.struct("d", "timing", F.round("z", 6).alias("z"))
    out = tape.groupBy("id", "cod", "phase", "pub_local").agg(
        argmax(size, *carried).alias("largest"),
        argmax(size, *carried, when=odd).alias("peak"),
        F.coalesce(F.bool_or(odd & F.col("closed_before")), F.lit(False)).alias("any_before"),
        F.sort_array(F.collect_list(F.when(odd, session))).alias("sessions"),
        F.min(F.when(F.col("is_reaction"), F.struct("d", "open_px", "open_share", "gap"))).alias("reaction"),
    )
    peak = F.col("peak")
    at_open = peak["is_reaction"] & (F.col("phase") == "in_session") & (peak["open_share"] > majority)
    status = (
        F.when(peak.isNull(), "NO_REACTION")
        .when(peak["closed_before"], "ALREADY_IN_PRICE")
        .when(F.col("any_before"), "PARTLY_IN_PRICE")
        .when(F.coalesce(at_open, F.lit(False)), "MOSTLY_AT_OPEN")
        .when(peak["is_reaction"], "REACTED")
        .otherwise("DELAYED")
    )
    opened = F.when((F.col("phase") == "in_session") & F.col("reaction.open_px").isNotNull(), F.struct(F.col("reaction.open_share").alias("open_share"), F.col("reaction.gap").alias("gap")))
    return out.withColumn("status", status).withColumn("at_open", opened).drop("any_before")


def first_articles(articles: DataFrame, *, key: str = "cod", at: str = "pub_utc", days: int = 7) -> DataFrame:
    """Articles at least `days` after the previous one of the same company, kept or not; order by time, then id."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at, "id"))
    return articles.withColumn("_b", before).where(F.col("_b").isNull() | (F.col(at) >= F.col("_b") + F.expr(f"INTERVAL {days} DAYS"))).drop("_b")


def first_articles_between(articles: DataFrame, start: str, end: str, *, key: str = "cod", at: str = "pub_utc", days: int = 7) -> DataFrame:
    """`first_articles` of a date range, reading `days` further back so that the range's first rows are judged rightly."""
    lo, hi = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    day = F.to_date(at)
    wide = articles.where(day.between(F.date_sub(lo, days), hi))
    return first_articles(wide, key=key, at=at, days=days).where(day.between(lo, hi))


def slots() -> Column:
    """The slots that a tape row feeds: at most two."""
    timing, phase = F.col("timing"), F.col("phase")
    same = F.when((timing == "same_day") & phase.isin("pre_open", "in_session", "after_close"), F.concat(F.lit("same_day_"), phase))
    later = F.when((timing == "later") & F.col("later_rank").isNotNull(), F.concat(F.lit("later_"), F.col("later_rank").cast("string")))
    return F.array_compact(F.array(F.when(timing == "day_before", "day_before"), F.when(F.col("is_reaction"), "reaction"), same, later))


def slot_lift(tape: DataFrame, rates: DataFrame) -> DataFrame:
    """For each slot: sessions, unusual ones, their share, the chance that applies, and the ratio."""
    tallies = tape.select(F.explode(slots()).alias("slot"), F.coalesce("unusual", F.lit(False)).alias("unusual")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.count_if("unusual").alias("n_unusual"))
    rule = F.create_map(*[F.lit(x) for pair in SLOTS for x in pair])[F.col("slot")]
    out = tallies.crossJoin(F.broadcast(rates.select("share_a", "share_b")))  # one row
    out = out.withColumn("chance", F.when(rule == "a", F.col("share_a")).otherwise(F.col("share_b"))).withColumn("share", F.col("n_unusual") / F.col("n"))
    return out.select("slot", "n", "n_unusual", "share", "chance", F.try_divide("share", "chance").alias("ratio"))


def status_table(judged: DataFrame, by: str) -> DataFrame:
    """Counts of each status by a column, zero where none."""
    return judged.groupBy(by).pivot("status", STATUSES).count().fillna(0)


def status_shares(judged: DataFrame, by: str) -> DataFrame:
    """(by, status, n, n_type, share, place): counts of each status with their share of the group, groups placed by size, then name. Groups are types, a few."""
    n = judged.groupBy(by, "status").agg(F.count(F.lit(1)).alias("n")).withColumn("n_type", F.sum("n").over(Window.partitionBy(by)))
    place = F.dense_rank().over(Window.orderBy(F.desc("n_type"), by)).cast("long")
    return n.select(by, "status", "n", "n_type", F.round(F.col("n") / F.greatest(F.lit(1), "n_type"), 6).alias("share"), place.alias("place"))


def lead_shares(judged: DataFrame) -> DataFrame:
    """Among articles with an unusual session: already or at the open, anything before, peak on the day before."""
    s = F.col("status")
    n = F.count_if(s != "NO_REACTION")
    out = judged.agg(
        n.alias("n_unusual"),
        F.count_if(s.isin("ALREADY_IN_PRICE", "MOSTLY_AT_OPEN")).alias("n_already"),
        F.count_if(s.isin("ALREADY_IN_PRICE", "PARTLY_IN_PRICE", "MOSTLY_AT_OPEN")).alias("n_before"),
        F.count_if((s != "NO_REACTION") & (F.col("peak.timing") == "day_before")).alias("n_day_before"),
    )
    return out.withColumns({f"share_{x}": F.try_divide(f"n_{x}", "n_unusual") for x in ("already", "before", "day_before")})


def card_dates(cards: DataFrame) -> DataFrame:
    """(id, d, z): the sessions a card tells of: its unusual ones, its largest and its peak, each day once. cards are `verdicts`."""
    named = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.d").alias("d"), F.round(f"{c}.z", 6).alias("z"))) for c in ("largest", "peak")]))
    told = F.concat(F.transform("sessions", lambda s: F.struct(s["d"].alias("d"), s["z"].alias("z"))), named)
    return cards.select("id", F.inline(told)).groupBy("id", "d").agg(F.first("z").alias("z"))


def reconcile(series: DataFrame, cards: DataFrame, told: DataFrame, *, rels: tuple[int, ...] = (-1, 0), places: int = 2) -> DataFrame:
    """(id, rel, d, series_z, card_z, state) for every article that has a series or a card and each relative session.

    no_card without a card; series_missing without the session; n/a where the card says nothing of its day; else OK or
    MISMATCH as both values agree to `places`. series has id, rel, d, z; cards id; told (id, d, z) what cards say.
    """
    ids = series.select("id").union(cards.select("id")).distinct().withColumn("rel", F.explode(F.array(*map(F.lit, rels))))
    s = series.where(F.col("rel").isin(*rels)).select("id", F.col("rel").cast("int").alias("rel"), "d", F.col("z").alias("series_z"), F.lit(True).alias("_series"))
    c = cards.select("id", F.lit(True).alias("_card")).distinct()
    x = ids.join(s, ["id", "rel"], "left").join(c, "id", "left").join(told.select("id", "d", F.col("z").alias("card_z")), ["id", "d"], "left")
    same = F.round("series_z", places).eqNullSafe(F.round("card_z", places))
    state = F.when(F.col("_card").isNull(), "no_card").when(F.col("_series").isNull(), "series_missing").when(F.col("card_z").isNull(), "n/a").when(same, "OK").otherwise("MISMATCH")
    return x.select("id", "rel", "d", "series_z", "card_z", state.alias("state"))
