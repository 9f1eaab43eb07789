"""Thesis evidence: quarters, ranked candidates, verdict roll-ups, votes, reactions to results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assign_quarters(rows: DataFrame, quarters: DataFrame, *, date: str) -> DataFrame:
    """Rows with the quarter whose window holds their date. quarters is a short table of disjoint windows."""
    q = F.broadcast(quarters)
    return rows.join(q, F.col(date).between(q["from_d"], q["to_d"]))


def top(rows: DataFrame, n: int, keys: list[str], *order: Column | str, name: str = "place") -> DataFrame:
    """The first n rows of each key in an order, numbered."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= n)


def results_candidates(rows: DataFrame, *, keys: list[str], preview: Column, score: Column, at: str, size: str, n: int = 2) -> DataFrame:
    """The best n rows of each key: announcements go first if there is any report, then score, earliest, longest."""
    w = Window.partitionBy(*keys)
    marked = rows.withColumn("_real", ~preview).withColumn("_score", score).withColumn("_any", F.max("_real").over(w))
    pool = marked.where(F.col("_real") | ~F.col("_any"))
    return top(pool, n, keys, F.desc("_score"), at, F.desc(size), "id").drop("_real", "_any")


def results_reaction(publications: DataFrame, sessions: DataFrame, *, close: str = "17:30:00") -> DataFrame:
    """Move that answers a publication, by whole sessions.

    Before the close: from the session before to the last session on or before the day, which on a non-trading day is the
    one before it. After the close: from the last session on or before the day to the next. Without either the move is null.
    """
    from tidemark.operators.tape import anchor

    # anchored one day on, idx_before is the last session on or before the publication day
    p = anchor(publications.withColumn("_next", F.date_add("pub_date", 1)), sessions, date="_next").drop("_next")
    by_idx = sessions.select("cod", "idx", "last")
    at = lambda off, name: by_idx.select("cod", (F.col("idx") - off).alias("idx_before"), F.col("last").alias(name))
    p = p.join(at(0, "on_px"), ["cod", "idx_before"]).join(at(-1, "before_px"), ["cod", "idx_before"], "left").join(at(1, "after_px"), ["cod", "idx_before"], "left")
    early = F.date_format("pub_local", "HH:mm:ss") < close
    move = F.when(early, F.try_divide("on_px", "before_px")).otherwise(F.try_divide("after_px", "on_px")) - 1
    return p.withColumn("move", move)


def since(dates: DataFrame, sessions: DataFrame) -> DataFrame:
    """(cod, change): last close against the close of the last session before each company's pub_date."""
    from tidemark.operators.tape import anchor

    whole = Window.partitionBy("cod").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sessions.select("cod", "d", "idx", F.col("last").alias("_b"), F.last("last").over(whole).alias("_close"))
    return anchor(dates, s, carry=["_b", "_close"]).select("cod", F.try_divide("_close", "_b").alias("x")).select("cod", (F.col("x") - 1).alias("change"))


def news_rollup(stories: DataFrame, tags: DataFrame, indicators: DataFrame, *, newest: int = 5) -> DataFrame:
    """Per company and indicator: stories, reactions, already known, none, newest titles; unknown tags go outside the thesis."""
    known = indicators.select("cod", "indicator").distinct().withColumn("_in", F.lit(True))
    rows = stories.join(tags, "id", "left").join(known, ["cod", "indicator"], "left")
    rows = rows.withColumn("bucket", F.when(F.col("_in"), F.col("indicator")).otherwise("outside"))
    w = Window.partitionBy("cod", "bucket").orderBy(F.desc("pub_local"), "id")
    rows = rows.withColumn("k", F.row_number().over(w))
    s = F.col("status")
    return rows.groupBy("cod", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s.isin("REACTED", "DELAYED")).alias("n_reaction"), F.count_if(s.isin("ALREADY_IN_PRICE", "PARTLY_IN_PRICE", "MOSTLY_AT_OPEN")).alias("n_already"), F.count_if(s == "NO_REACTION").alias("n_none"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("k") <= newest, F.struct("k", "id")))), lambda x: x["id"]), ",").alias("newest"))


def news_by_indicator(stories: DataFrame, tags: DataFrame, indicators: DataFrame) -> DataFrame:
    """For every company and indicator of its thesis, and for what is outside it, stories and their verdict groups; those without a story too."""
    known = indicators.select("cod", "indicator").distinct().withColumn("_in", F.lit(True))
    rows = stories.join(tags, "id", "left").join(known, ["cod", "indicator"], "left").withColumn("bucket", F.when(F.col("_in"), F.col("indicator")).otherwise("outside"))
    s, moved = F.col("status"), F.col("status") != "NO_REACTION"
    n = rows.groupBy("cod", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s.isin("REACTED", "DELAYED")).alias("n_reaction"), F.count_if(s.isin("ALREADY_IN_PRICE", "PARTLY_IN_PRICE", "MOSTLY_AT_OPEN")).alias("n_already"), F.count_if(~moved).alias("n_none"),
        F.count_if(moved & (F.col("peak_ret") > 0)).alias("up"), F.count_if(moved & (F.col("peak_ret") < 0)).alias("down"))
    wanted = known.select("cod", F.col("indicator").alias("bucket")).union(known.select("cod", F.lit("outside"))).distinct()
    return wanted.join(n, ["cod", "bucket"], "left").na.fill(0)


def results_score(title: str, name: str, own: str, words: str) -> Column:
    """How much a title reads like a report of results: results words, two more if it opens with the company's name, one more from the company's own file."""
    low = F.lower(title)
    return (F.regexp_count(low, F.lit(rf"\b(?:{words})\b")) + F.when(low.startswith(F.lower(name)), 2).otherwise(0) + F.when(F.col(own), 1).otherwise(0)).cast("long")


def recalc_diff(before: DataFrame, after: DataFrame, was: DataFrame, now: DataFrame) -> DataFrame:
    """(cod, status, decision, indicators, summary_changed) for companies of both states: what a new run of a thesis changed.

    before and after have cod, status, action, summary; was and now (cod, name, state) of indicators. Changes read
    `old>new`, those of indicators `name:old>new` by name; null or empty where nothing changed. Indicators of now alone count.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    change = lambda a, b: F.when(blank(a) != blank(b), F.concat(F.coalesce(a, F.lit("-")), F.lit(">"), F.coalesce(b, F.lit("-"))))
    i = now.join(was.select("cod", "name", F.col("state").alias("_old")), ["cod", "name"], "left").where(~F.col("state").eqNullSafe(F.col("_old")))
    i = i.groupBy("cod").agg(F.array_join(F.sort_array(F.collect_list(F.concat("name", F.lit(":"), F.coalesce("_old", F.lit("-")), F.lit(">"), "state"))), ",").alias("indicators"))
    x = after.join(before.select("cod", *[F.col(c).alias(f"_{c}") for c in ("status", "action", "summary")]), "cod").join(i, "cod", "left")
    return x.select("cod", change("_status", "status").alias("status"), change("_action", "action").alias("decision"), blank("indicators").alias("indicators"), (F.trim(blank("_summary")) != F.trim(blank("summary"))).alias("summary_changed"))


def thesis_hits(stories: DataFrame, theses: DataFrame, *, words: str = r"[0-9A-Za-z]{3,}") -> DataFrame:
    """(ticker, id, hits): distinct words that a thesis's indicators share with a title, by an equi-join on words."""
    t = theses.select("ticker", F.explode("indicators").alias("indicator"))
    t = t.select("ticker", "indicator", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("indicator"), F.lit(words), 0))).alias("word"))
    s = stories.select("id", F.col("cod").alias("ticker"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(words), 0))).alias("word"))
    return s.join(t, ["ticker", "word"]).groupBy("ticker", "id", "indicator").agg(F.count_distinct("word").alias("hits"))


def changed_only(now: DataFrame, built: DataFrame, *, key: str, fingerprint: str) -> DataFrame:
    """Rows whose key and input fingerprint were not built before."""
    return now.join(built, [key, fingerprint], "left_anti")


def fingerprinted(rows: DataFrame, fields: list[str], *, version: str) -> DataFrame:
    """rows plus fp: 16 hexadecimal digits over the version of the job and the fields, so that a new version builds all anew."""
    return rows.withColumn("fp", F.substring(F.sha2(F.concat_ws("\n", F.lit(version), F.to_json(F.struct(*fields))), 256), 1, 16))


def overridden(rows: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """rows with each field that an override names, with null too, taken from it. overrides has the key and a map `fields` of strings."""
    kinds = dict(rows.dtypes)
    out = rows.join(overrides.withColumnRenamed("fields", "_fields"), key, "left")
    named = lambda f: F.coalesce(F.map_contains_key("_fields", f), F.lit(False))
    return out.withColumns({f: F.when(named(f), F.col("_fields")[f].cast(kinds[f])).otherwise(F.col(f)) for f in fields}).drop("_fields")
