"""Sector sentiment: market legs, narrative from embeddings, tilted index and composite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEGS = ["momentum", "strength", "breadth", "volatility", "narrative"]
#: Base weight and tilt by narrative of each leg; band edges and labels.
TILT = {"momentum": 0.10, "strength": 0.05, "breadth": -0.05, "volatility": -0.10, "narrative": 0.0}
BANDS = [(25, "Extreme fear"), (45, "Fear"), (55, "Neutral"), (75, "Greed")]


def name_days(quotes: DataFrame, members: DataFrame) -> DataFrame:
    """Sessions of members with the trailing deviation and the year's high and low."""
    from tidemark.operators.tape import rolling, sessions

    rows = sessions(quotes.join(members.select("cod").distinct(), "cod", "left_semi"))
    rows = rolling(rows, -20, -1, "b").join(members, "cod")
    year = Window.partitionBy("cod").orderBy("idx").rowsBetween(-251, 0)
    return rows.withColumns({"high_52": F.max("high").over(year), "low_52": F.min("low").over(year), "n_52": F.count("high").over(year)})


def sector_days(days: DataFrame) -> DataFrame:
    """Per sector and day: mean move, shocks up and down, names near their year's high and low, volumes of risers and fallers."""
    ret = F.col("ret")
    based = (F.col("n_b") == 20) & (F.col("sd_b") > 0)
    shock = based & (F.abs("ret") >= 2 * F.col("sd_b"))
    full = F.col("n_52") >= 252
    return days.where(ret.isNotNull()).groupBy("sector", "d").agg(
        F.avg("ret").alias("sector_ret"),
        F.count_if(based).alias("names"),
        F.count_if(shock).alias("shocks"),
        F.count_if(shock & (ret < 0)).alias("shocks_down"),
        F.count_if(shock & (ret > 0)).alias("shocks_up"),
        F.count_if(full & (F.col("high_52") > 0) & (F.col("last") >= 0.95 * F.col("high_52"))).alias("n_high"),
        F.count_if(full & (F.col("low_52") > 0) & (F.col("last") <= 1.05 * F.col("low_52"))).alias("n_low"),
        F.count_if(full & (F.col("high_52") > 0) & (F.col("low_52") > 0)).alias("n_strength"),
        F.sum(F.when(ret > 0, F.col("qty")).otherwise(0)).alias("up_qty"),
        F.sum(F.when(ret < 0, F.col("qty")).otherwise(0)).alias("down_qty"),
        F.sum("qty").alias("total_qty"),
    )


def sector_legs(days: DataFrame) -> DataFrame:
    """Strength, breadth, compounded momentum over 125 days and volatility over 20, with their counts."""
    w = lambda n: Window.partitionBy("sector").orderBy("d").rowsBetween(-(n - 1), 0)
    log = F.ln(F.when(1 + F.col("sector_ret") > 0, 1 + F.col("sector_ret")))
    return days.withColumns({
        "strength_raw": F.try_divide(F.col("n_high") - F.col("n_low"), F.col("n_strength")),
        "breadth_raw": F.try_divide(F.col("up_qty") - F.col("down_qty"), F.col("total_qty")),
        "momentum_raw": F.exp(F.sum(log).over(w(125))) - 1,
        "n_mom": F.count(log).over(w(125)),
        "vol_raw": F.stddev_samp("sector_ret").over(w(20)),
        "n_vol": F.count("sector_ret").over(w(20)),
    })


def gate(legs: DataFrame) -> DataFrame:
    """Days with a full history of every leg."""
    return legs.where("n_mom = 125 and n_vol = 20 and n_strength > 0 and strength_raw is not null and breadth_raw is not null and momentum_raw is not null and vol_raw > 0")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_mean(rows: DataFrame, *keys: str, vector: str = "embedding", dim: int) -> DataFrame:
    """Element-wise mean of vectors of the given dimension, in order, by key; partial sums before the shuffle."""
    parts = rows.where(F.size(vector) == dim).select(*keys, F.posexplode(vector).alias("pos", "v"))
    means = parts.groupBy(*keys, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    out = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("x"))
    return out.where(F.size("x") == dim).select(*keys, F.transform("x", lambda p: p["v"]).alias(vector))


def best_sector(vectors: DataFrame, sectors: DataFrame, *, least: float = 0.40) -> DataFrame:
    """The sector of highest cosine for each article, if high enough; ties by sector name. sectors has a row for each sector."""
    pairs = vectors.crossJoin(F.broadcast(sectors.select("sector", F.col("embedding").alias("s"))))
    scored = pairs.withColumn("cosine", cosine(F.col("embedding"), F.col("s"))).drop("s")
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "sector")
    return scored.withColumn("k", F.row_number().over(w)).where((F.col("k") == 1) & (F.col("cosine") >= least)).drop("k")


def percentile(value: str, key: str = "sector") -> Column:
    """Percent of the key's whole history at or below the value."""
    return 100 * F.cume_dist().over(Window.partitionBy(key).orderBy(value))


def label(score: Column) -> Column:
    out = F.when(score < BANDS[0][0], BANDS[0][1])
    for edge, name in BANDS[1:]:
        out = out.when(score < edge, name)
    return out.otherwise("Extreme greed")


def sector_index(days: DataFrame, *, neutral: float = 50.0) -> DataFrame:
    """Component percentiles, carried narrative, tilted weights, score and label of each sector and day."""
    carry = F.coalesce(F.last("narrative_pct", True).over(Window.partitionBy("sector").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)), F.lit(neutral))
    out = days.withColumns({
        "momentum": percentile("momentum_raw"), "strength": percentile("strength_raw"), "breadth": percentile("breadth_raw"),
        "volatility": 100 - percentile("vol_raw"), "narrative": carry,
    })
    bias = (F.col("narrative") - neutral) / neutral
    out = out.withColumns({f"w_{x}": 0.20 + TILT[x] * bias for x in LEGS})
    total = sum(F.col(f"w_{x}") for x in LEGS)
    out = out.withColumns({f"w_{x}": F.col(f"w_{x}") / total for x in LEGS})
    score = sum(F.col(x) * F.col(f"w_{x}") for x in LEGS)
    return out.withColumn("score", score).withColumn("label", label(score))


def trailing(days: DataFrame, key: str, n: int = 5) -> DataFrame:
    w = Window.partitionBy(key).orderBy("d").rowsBetween(-(n - 1), 0)
    return days.withColumns({f"{x}_5d": F.sum(x).over(w) for x in ("shocks", "shocks_down", "shocks_up")})


def composite(index: DataFrame) -> DataFrame:
    """Mean over sectors on the days that every sector has; shocks summed."""
    sectors = index.agg(F.count_distinct("sector").alias("n_sectors"))
    sums = {x: F.sum(x) for x in ("shocks", "shocks_down", "shocks_up", "names")}
    out = index.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"), *[F.avg(x).alias(x) for x in LEGS], *[e.alias(x) for x, e in sums.items()])
    out = out.crossJoin(F.broadcast(sectors)).where("n = n_sectors").drop("n", "n_sectors")
    return out.withColumn("label", label(F.col("score")))


def membership_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """(sector, cod, change) between two ordered lists (sector, cod, pos): added, removed, or moved to another place."""
    n, b = now.withColumnRenamed("pos", "_now"), before.withColumnRenamed("pos", "_before")
    change = F.when(F.col("_before").isNull(), "added").when(F.col("_now").isNull(), "removed").when(F.col("_now") != F.col("_before"), "moved")
    return n.join(b, ["sector", "cod"], "full").withColumn("change", change).where("change is not null").select("sector", "cod", "change")


def sector_of(tickers: DataFrame, lists: DataFrame) -> DataFrame:
    """(cod, sector): the first sector, by pos, whose list of tickers holds each code; null without one. lists are taken apart and met by an equi-join."""
    first = lists.select("pos", "sector", F.explode("tickers").alias("cod")).groupBy("cod").agg(F.min_by("sector", "pos").alias("sector"))
    return tickers.join(first, "cod", "left").select("cod", "sector")
