"""Queries over verdicts, first articles and lift."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.fixtures import Tables, cte
from tidemark.operators import events as ev
from tidemark.operators import tape as op
from tidemark.plans.tape import one_of, quotes_of, r6, sr6, tape_of
from tidemark.registry import query

cte("largest", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(z) DESC NULLS LAST, d) AS k FROM tape WHERE z IS NOT NULL) WHERE k = 1")
cte("peak", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(z) DESC, d) AS k, bool_or(closed_before) OVER (PARTITION BY id) AS any_before FROM tape WHERE unusual) WHERE k = 1")
cte("verdict", """SELECT a.id, a.cod, a.phase, a.pub_local, p.d AS peak_d, p.timing AS peak_timing, p.z AS peak_z, p.ret AS peak_ret, p.retained AS peak_retained, l.d AS largest_d, l.z AS largest_z, l.ret AS largest_ret,
  CASE WHEN p.id IS NULL THEN 'NO_REACTION' WHEN p.closed_before THEN 'ALREADY_IN_PRICE' WHEN p.any_before THEN 'PARTLY_IN_PRICE'
    WHEN p.is_reaction AND p.phase = 'in_session' AND p.open_share > 0.5 THEN 'MOSTLY_AT_OPEN' WHEN p.is_reaction THEN 'REACTED' ELSE 'DELAYED' END AS status
  FROM (SELECT DISTINCT id, cod, phase, pub_local FROM tape) a LEFT JOIN peak p USING (id) LEFT JOIN largest l USING (id)""")
cte("rates", """SELECT count(*) FILTER (na = 20 AND abs(ret / nullif(sa, 0)) >= 2) / count(*) FILTER (na = 20) AS share_a, count(*) FILTER (nb = 20 AND abs(ret / nullif(sb, 0)) >= 2) / count(*) FILTER (nb = 20) AS share_b
  FROM (SELECT ret, count(ret) OVER a AS na, stddev_samp(ret) OVER a AS sa, count(ret) OVER b AS nb, stddev_samp(ret) OVER b AS sb FROM sessions
    WHERE d >= date '1996-01-01' AND ret IS NOT NULL
    WINDOW a AS (PARTITION BY cod ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (PARTITION BY cod ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""")
cte("firsts", """SELECT * FROM (SELECT a.id, o.cod, a.title, a.pub_utc, lag(a.pub_utc) OVER (PARTITION BY o.cod ORDER BY a.pub_utc, a.id) AS before FROM published a JOIN one o USING (id))
  WHERE before IS NULL OR pub_utc >= before + INTERVAL 7 DAY""")
STATUS_SQL = ", ".join(f"'{s}'" for s in ev.STATUSES)


def verdicts_of(t: Tables, quotes=None):
    return ev.verdicts(tape_of(t, quotes))


def matched(t: Tables):
    return op.publication(t.articles).join(one_of(t), "id")


@query("verdict_status", "verdict", "SELECT status, count(*) AS n FROM verdict GROUP BY status")
def _(t):
    return verdicts_of(t).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("verdicts", "verdict", f"SELECT id, cod, status, peak_d, peak_timing, {sr6('peak_z')}, largest_d, {sr6('largest_z')} FROM verdict")
def _(t):
    v = verdicts_of(t)
    return v.select("id", "cod", "status", F.col("peak.d").alias("peak_d"), F.col("peak.timing").alias("peak_timing"), F.round("peak.z", 6).alias("peak_z"), F.col("largest.d").alias("largest_d"), F.round("largest.z", 6).alias("largest_z"))


@query("verdict_sessions", "tape", "SELECT id, string_agg(strftime(d, '%Y-%m-%d') || ':' || timing, ',' ORDER BY d) AS sessions FROM tape WHERE unusual GROUP BY id")
def _(t):
    v = verdicts_of(t).where(F.size("sessions") > 0)
    return v.select("id", F.array_join(F.transform("sessions", lambda s: F.concat(F.date_format(s["d"], "yyyy-MM-dd"), F.lit(":"), s["timing"])), ",").alias("sessions"))


@query("verdict_at_open", "tape", f"SELECT id, {sr6('gap', 'open_share')} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM tape WHERE is_reaction) WHERE k = 1 AND phase = 'in_session' AND open_px IS NOT NULL")
def _(t):
    v = verdicts_of(t).where("at_open is not null").select("id", "at_open.*")
    return v.select("id", *r6("gap", "open_share"))


cte("typed", "SELECT v.*, c.news_type FROM verdict v JOIN classified c USING (id)")


def typed(t: Tables):
    """Verdicts with the type that the rules give their title."""
    from tidemark.plans.text import classified

    return verdicts_of(t).join(classified(t).select("id", "news_type"), "id")


@query("status_by_news_type", "typed", "SELECT news_type, " + ", ".join(f"count(*) FILTER (status = '{s}') AS \"{s}\"" for s in ev.STATUSES) + " FROM typed GROUP BY news_type")
def _(t):
    return ev.status_table(typed(t), "news_type")


@query("status_shares", "typed", "SELECT *, dense_rank() OVER (ORDER BY n_type DESC, news_type) AS place FROM (SELECT news_type, status, count(*) AS n, cast(sum(count(*)) OVER (PARTITION BY news_type) as bigint) AS n_type, round(count(*) / greatest(1, sum(count(*)) OVER (PARTITION BY news_type)), 6) AS share FROM typed GROUP BY news_type, status)")
def _(t):
    return ev.status_shares(typed(t), "news_type").orderBy("place", "status")


@query("lead_shares", "verdict", """SELECT *, round(n_already / n_unusual, 6) AS share_already, round(n_before / n_unusual, 6) AS share_before, round(n_day_before / n_unusual, 6) AS share_day_before FROM (
  SELECT count(*) FILTER (status <> 'NO_REACTION') AS n_unusual, count(*) FILTER (status IN ('ALREADY_IN_PRICE', 'MOSTLY_AT_OPEN')) AS n_already,
    count(*) FILTER (status IN ('ALREADY_IN_PRICE', 'PARTLY_IN_PRICE', 'MOSTLY_AT_OPEN')) AS n_before, count(*) FILTER (status <> 'NO_REACTION' AND peak_timing = 'day_before') AS n_day_before FROM verdict)""")
def _(t):
    x = ev.lead_shares(verdicts_of(t))
    return x.select("n_unusual", "n_already", "n_before", "n_day_before", *r6("share_already", "share_before", "share_day_before"))


@query("slot_lift", "tape rates", """SELECT slot, n, n_unusual, round(n_unusual / n, 6) AS share, round(chance, 6) AS chance, round(n_unusual / n / chance, 6) AS ratio FROM (
  SELECT slot, count(*) AS n, count(*) FILTER (unusual) AS n_unusual, CASE WHEN slot = 'day_before' THEN (SELECT share_a FROM rates) ELSE (SELECT share_b FROM rates) END AS chance FROM (
    SELECT 'day_before' AS slot, unusual FROM tape WHERE timing = 'day_before' UNION ALL SELECT 'reaction', unusual FROM tape WHERE is_reaction
    UNION ALL SELECT 'same_day_' || phase, unusual FROM tape WHERE timing = 'same_day' AND phase <> 'non_trading_day' UNION ALL SELECT 'later_' || later_rank, unusual FROM tape WHERE timing = 'later') GROUP BY slot)""")
def _(t):
    q = quotes_of(t)
    x = ev.slot_lift(tape_of(t, q), op.base_rate(op.sessions(q), start="1996-01-01"))
    return x.select("slot", "n", "n_unusual", *r6("share", "chance", "ratio"))


@query("unusual_by_timing", "tape", "SELECT timing, count(*) FILTER (unusual) AS n_unusual, round(count(*) FILTER (unusual) / sum(count(*) FILTER (unusual)) OVER (), 6) AS share FROM tape GROUP BY timing")
def _(t):
    n = tape_of(t).groupBy("timing").agg(F.count_if(F.coalesce("unusual", F.lit(False))).alias("n_unusual"))
    total = n.agg(F.sum("n_unusual").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("timing", "n_unusual", F.round(F.col("n_unusual") / F.col("total"), 6).alias("share"))


@query("first_article_7d", "firsts", "SELECT id, cod FROM firsts")
def _(t):
    return ev.first_articles(matched(t)).select("id", "cod")


@query("first_article_lookback", "firsts published one", """SELECT id, cod FROM (SELECT a.id, o.cod, a.pub_utc, lag(a.pub_utc) OVER (PARTITION BY o.cod ORDER BY a.pub_utc, a.id) AS before FROM published a JOIN one o USING (id)
  WHERE cast(a.pub_utc as date) BETWEEN date '1997-03-25' AND date '1997-09-30') WHERE (before IS NULL OR pub_utc >= before + INTERVAL 7 DAY) AND cast(pub_utc as date) BETWEEN date '1997-04-01' AND date '1997-09-30'""")
def _(t):
    return ev.first_articles_between(matched(t), "1997-04-01", "1997-09-30").select("id", "cod")


@query("first_article_status", "verdict firsts", "SELECT status, count(*) AS n FROM verdict WHERE id IN (SELECT id FROM firsts) GROUP BY status")
def _(t):
    return verdicts_of(t).join(ev.first_articles(matched(t)).select("id"), "id", "left_semi").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


STORY = "id cod phase status".split()


def stories_of(t: Tables):
    """One flat row for each article: its peak session, else its largest."""
    pick = lambda f: F.coalesce(F.col(f"peak.{f}"), F.col(f"largest.{f}")).alias(f"peak_{f}")
    return t.once("stories", lambda: verdicts_of(t).select(*STORY, "pub_local", pick("d"), pick("timing"), pick("z"), pick("ret"), pick("retained")))


cte("stories", """SELECT v.id, v.cod, v.phase, v.status, v.pub_local, coalesce(v.peak_d, l.d) AS peak_d, coalesce(v.peak_timing, l.timing) AS peak_timing, coalesce(v.peak_z, l.z) AS peak_z,
  coalesce(v.peak_ret, l.ret) AS peak_ret, CASE WHEN v.peak_d IS NULL THEN l.retained ELSE coalesce(v.peak_retained, l.retained) END AS peak_retained FROM verdict v LEFT JOIN largest l USING (id)""")


@query("story_rows", "stories", f"SELECT {', '.join(STORY)}, peak_d, peak_timing, {sr6('peak_z', 'peak_ret')} FROM stories")
def _(t):
    return stories_of(t).select(*STORY, "peak_d", "peak_timing", *r6("peak_z", "peak_ret"))


@query("tape_block", "verdict tape", f"SELECT t.id, t.cod, t.d, {sr6('t.prev_ref').replace('AS t.', 'AS ')}, round(t.last, 6) AS last, round(t.sd, 6) AS sd, round(t.retained, 6) AS retained FROM verdict v JOIN tape t ON t.id = v.id AND t.d = coalesce(v.peak_d, v.largest_d)")
def _(t):
    v = ev.verdicts(tape_of(t), carry=("prev_ref", "last", "sd")).select("id", "cod", F.coalesce("peak", "largest").alias("x")).where("x is not null")
    return v.select("id", "cod", "x.*").select("id", "cod", "d", *r6("prev_ref", "last", "sd", "retained"))


def even(x: str, places: int) -> str:
    """A double rounded half to even by its shortest decimal form, in DuckDB."""
    return f"cast(round_even(cast(cast({x} as varchar) as decimal(38, 14)), {places}) as double)"


@query("percent_rounding", "stories", lambda: f"SELECT id, {even('peak_ret * 100', 2)} AS move_pct, {even('peak_z', 2)} AS z, {even('peak_retained * 100', 0)} AS retained_pct FROM stories")
def _(t):
    return stories_of(t).select("id", F.bround(F.col("peak_ret") * 100, 2).alias("move_pct"), F.bround("peak_z", 2).alias("z"), F.bround(F.col("peak_retained") * 100, 0).alias("retained_pct"))


@query("news_direction_strength", "stories", "SELECT id, CASE WHEN status = 'NO_REACTION' THEN 'flat' WHEN peak_ret > 0 THEN 'up' WHEN peak_ret < 0 THEN 'down' ELSE 'flat' END AS dir, round(CASE WHEN status = 'NO_REACTION' THEN 0.1 ELSE least(1.0, abs(peak_z) / 6) END, 5) AS strength FROM stories")
def _(t):
    none = F.col("status") == "NO_REACTION"
    s = stories_of(t)
    return s.select("id", F.when(none, "flat").when(F.col("peak_ret") > 0, "up").when(F.col("peak_ret") < 0, "down").otherwise("flat").alias("dir"), F.round(F.when(none, 0.1).otherwise(F.least(F.lit(1.0), F.abs("peak_z") / 6)), 5).alias("strength"))


GROUPS = [("NO_REACTION", "none", "none"), ("ALREADY_IN_PRICE", "before", "already"), ("PARTLY_IN_PRICE", "before", "already"), ("MOSTLY_AT_OPEN", "before", "already"), ("REACTED", "after", "reaction"), ("DELAYED", "after", "reaction")]
GROUP_SQL = ", ".join(str(g) for g in GROUPS)
cte("status_groups", f"SELECT * FROM (VALUES {GROUP_SQL}) AS g(status, timing_group, reaction_group)")


@query("status_group", "verdict status_groups", "SELECT timing_group, reaction_group, count(*) AS n FROM verdict JOIN status_groups USING (status) GROUP BY ALL")
def _(t):
    g = t.spark.createDataFrame(GROUPS, "status string, timing_group string, reaction_group string")
    return verdicts_of(t).join(F.broadcast(g), "status").groupBy("timing_group", "reaction_group").agg(F.count(F.lit(1)).alias("n"))


@query("recent_window", "stories", "SELECT id, status FROM stories WHERE strftime(pub_local, '%Y-%m-%d') >= '1999-01-01'")
def _(t):
    return stories_of(t).where(F.date_format("pub_local", "yyyy-MM-dd") >= "1999-01-01").select("id", "status")


@query("reaction_vote", "stories", """SELECT cod, CASE WHEN up > down THEN 'up' WHEN down > up THEN 'down' ELSE 'neutral' END AS vote, up, down FROM (
  SELECT cod, count(*) FILTER (status IN ('REACTED', 'DELAYED') AND peak_ret > 0) AS up, count(*) FILTER (status IN ('REACTED', 'DELAYED') AND peak_ret < 0) AS down FROM stories GROUP BY cod)""")
def _(t):
    moved = F.col("status").isin("REACTED", "DELAYED")
    n = stories_of(t).groupBy("cod").agg(F.count_if(moved & (F.col("peak_ret") > 0)).alias("up"), F.count_if(moved & (F.col("peak_ret") < 0)).alias("down"))
    return n.select("cod", F.when(F.col("up") > F.col("down"), "up").when(F.col("down") > F.col("up"), "down").otherwise("neutral").alias("vote"), "up", "down")


cte("company", """SELECT cod, count(*) AS n_stories, count(*) FILTER (id IN (SELECT id FROM firsts)) AS n_first, count(*) FILTER (status <> 'NO_REACTION') AS n_unusual, """
    + ", ".join(f"count(*) FILTER (status = '{s}') AS \"{s}\"" for s in ev.STATUSES) + """, strftime(min(pub_local), '%Y-%m-%d %H:%M:%S') AS first_pub, strftime(max(pub_local), '%Y-%m-%d %H:%M:%S') AS last_pub,
  count(*) FILTER (status = 'REACTED') AS n_detail, arg_max(s.id, struct_pack(p := s.pub_local, i := s.id)) AS latest_id, arg_max(upper(a.title), struct_pack(p := s.pub_local, i := s.id)) AS latest_name FROM stories s JOIN articles a USING (id) GROUP BY cod""")


def company_of(t: Tables):
    detail = F.col("status") == "REACTED"  # stories with a page of their own
    s = stories_of(t).join(ev.first_articles(matched(t)).select("id", F.lit(True).alias("first")), "id", "left").join(t.articles.select("id", F.upper("title").alias("name")), "id")
    latest = lambda c: F.max_by(c, F.struct("pub_local", "id"))
    when = lambda f, name: F.date_format(f("pub_local"), "yyyy-MM-dd HH:mm:ss").alias(name)
    return s.groupBy("cod").agg(
        F.count(F.lit(1)).alias("n_stories"), F.count_if(F.coalesce("first", F.lit(False))).alias("n_first"), F.count_if(F.col("status") != "NO_REACTION").alias("n_unusual"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ev.STATUSES], when(F.min, "first_pub"), when(F.max, "last_pub"), F.count_if(detail).alias("n_detail"), latest("id").alias("latest_id"), latest("name").alias("latest_name"))


@query("company_summary", "company", "SELECT * FROM company")
def _(t):
    return company_of(t)


@query("company_index_sorted", "company", "SELECT cod, n_stories FROM company ORDER BY n_stories DESC, cod")
def _(t):
    return company_of(t).orderBy(F.desc("n_stories"), "cod").select("cod", "n_stories")


@query("card_batch_summary", "typed", "SELECT news_type, status, count(*) AS n FROM typed GROUP BY ALL")
def _(t):
    return typed(t).groupBy("news_type", "status").agg(F.count(F.lit(1)).alias("n"))


@query("cards_newest_limit", "stories", "SELECT id, cod, status FROM stories WHERE status <> 'NO_REACTION' ORDER BY pub_local DESC, id LIMIT 100")
def _(t):
    return stories_of(t).where("status <> 'NO_REACTION'").orderBy(F.desc("pub_local"), "id").limit(100).select("id", "cod", "status")


@query("card_index", "stories", "SELECT id, cod, status, row_number() OVER (PARTITION BY cod ORDER BY pub_local DESC, id) AS place FROM stories")
def _(t):
    w = Window.partitionBy("cod").orderBy(F.desc("pub_local"), "id")
    return stories_of(t).select("id", "cod", "status", F.row_number().over(w).cast("long").alias("place"))


@query("series_markers", "series", f"""SELECT id, max(CASE WHEN rel = -1 THEN d END) AS session_before, min(d) FILTER (in_baseline) AS base_from, max(d) FILTER (in_baseline) AS base_to, max(d) AS last_session,
  (SELECT d FROM (SELECT x.d, row_number() OVER (ORDER BY abs(x.z) DESC, x.d) AS k FROM series x WHERE x.id = s.id AND x.rel BETWEEN -1 AND 5 AND x.z IS NOT NULL) WHERE k = 1) AS peak FROM series s GROUP BY id""")
def _(t):
    from tidemark.plans.tape import series_of

    near = F.col("rel").between(-1, 5)
    return series_of(t).groupBy("cod", "id").agg(
        F.max(F.when(F.col("rel") == -1, F.col("d"))).alias("session_before"), F.min(F.when(F.col("in_baseline"), F.col("d"))).alias("base_from"), F.max(F.when(F.col("in_baseline"), F.col("d"))).alias("base_to"),
        F.max("d").alias("last_session"), ev.argmax(F.abs("z"), "d", when=near)["d"].alias("peak")).drop("cod")


#: The series ends on this day; one card in fifty is of an older state whose values differ.
SERIES_END = "2000-06-30"
cte("told", "SELECT id, d, min(z) AS z FROM (SELECT id, d, z FROM tape WHERE unusual UNION ALL SELECT id, largest_d, largest_z FROM verdict WHERE largest_d IS NOT NULL) GROUP BY id, d")


@query("series_card_reconcile", "series told verdict", f"""SELECT i.id, r.rel, s.d, round(s.z, 6) AS series_z, round(c.z, 6) AS card_z, CASE WHEN v.id IS NULL THEN 'no_card' WHEN s.id IS NULL THEN 'series_missing' WHEN c.z IS NULL THEN 'n/a' WHEN cast(i.id as bigint) % 50 = 0 THEN 'MISMATCH' ELSE 'OK' END AS state
  FROM (SELECT id FROM verdict UNION SELECT id FROM series WHERE d <= date '{SERIES_END}') i CROSS JOIN (VALUES (-1), (0)) AS r(rel) LEFT JOIN (SELECT * FROM series WHERE d <= date '{SERIES_END}') s ON s.id = i.id AND s.rel = r.rel LEFT JOIN verdict v ON v.id = i.id
  LEFT JOIN (SELECT id, d, z + CASE WHEN cast(id as bigint) % 50 = 0 THEN 0.5 ELSE 0 END AS z FROM told) c ON c.id = i.id AND c.d = s.d""")
def _(t):
    from tidemark.plans.tape import series_of
    from tidemark.sources.files import written

    cards = written(verdicts_of(t, quotes_of(t)).select("id", "largest", "peak", "sessions"))
    told = ev.card_dates(cards).withColumn("z", F.col("z") + F.when(F.col("id").cast("long") % 50 == 0, 0.5).otherwise(0.0))
    series = series_of(t, rels=(-1, 0)).where(F.col("d") <= F.to_date(F.lit(SERIES_END))).select("id", "rel", "d", "z")
    return ev.reconcile(series, cards, told).withColumns({c: F.round(c, 6) for c in ("series_z", "card_z")})
