"""Queries over sessions, baselines and the event window."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.fixtures import Tables, cte
from tidemark.operators import tape as op
from tidemark.registry import query

STOP = ["Supplier#000000004", "Supplier#000000005"]

cte("valid", "SELECT * FROM quotes WHERE last > 0 AND ref > 0")
cte("sessions", """SELECT *, last / nullif(prev_ref, 0) - 1 AS ret FROM (
  SELECT *, lag(ref) OVER w AS prev_ref, row_number() OVER w AS idx FROM valid WINDOW w AS (PARTITION BY cod ORDER BY d))""")
cte("universe", f"""SELECT n.* FROM names n WHERE kind = 'ORD' AND isin LIKE 'IT%' AND length(trim(name)) >= 3
  AND upper(trim(name)) NOT IN ({', '.join("'" + s.upper() + "'" for s in STOP)}) AND cod IN (SELECT cod FROM quotes)""")
cte("loose", "SELECT n.* FROM names n WHERE kind = 'ORD' AND isin LIKE 'IT%' AND length(trim(name)) >= 3 AND cod IN (SELECT cod FROM quotes)")
cte("published", """SELECT *, cast(pub_local as date) AS pub_date FROM (
  SELECT *, timezone('Europe/Rome', timezone('UTC', pub_utc)) AS pub_local FROM articles WHERE NOT starts_with(title, 'Live blog'))""")
# names are single tokens of titles
cte("matches", "SELECT DISTINCT a.id, n.cod FROM (SELECT id, unnest(regexp_extract_all(title, '[0-9A-Za-z_#]+')) AS token FROM published) a JOIN universe n ON n.name = a.token")
cte("one", "SELECT id, min(cod) AS cod FROM matches GROUP BY id HAVING count(*) = 1")
cte("anchored", """SELECT a.id, o.cod, a.title, a.pub_utc, a.pub_local, a.pub_date, max(s.idx) AS idx_before FROM published a JOIN one o USING (id)
  JOIN sessions s ON s.cod = o.cod AND s.d < a.pub_date GROUP BY ALL""")
cte("based", """SELECT a.*, count(s.ret) AS n_base, stddev_samp(s.ret) AS sd, avg(s.qty) AS avg_qty, min(s.d) AS base_from, max(s.d) AS base_to
  FROM anchored a JOIN sessions s ON s.cod = a.cod AND s.idx BETWEEN a.idx_before - 19 AND a.idx_before GROUP BY ALL""")
cte("phased", """SELECT b.*, CASE WHEN NOT EXISTS (SELECT 1 FROM sessions s WHERE s.cod = b.cod AND s.d = b.pub_date) THEN 'non_trading_day'
  WHEN strftime(pub_local, '%H:%M:%S') < '09:00:00' THEN 'pre_open' WHEN strftime(pub_local, '%H:%M:%S') < '17:30:00' THEN 'in_session' ELSE 'after_close' END AS phase
  FROM based b WHERE n_base = 20""")
cte("opened", """SELECT *, CASE WHEN open > 0 AND (NOT (low > 0 AND high > 0) OR open BETWEEN low * 0.9999 AND high * 1.0001) THEN open END AS open_px FROM sessions""")
cte("windowed", """SELECT p.*, s.idx, s.d, s.last, s.ref, s.prev_ref, s.ret, s.qty, s.open_px,
  CASE WHEN s.d < p.pub_date THEN 'day_before' WHEN s.d = p.pub_date THEN 'same_day' ELSE 'later' END AS timing,
  CASE WHEN s.d > p.pub_date THEN row_number() OVER (PARTITION BY p.id, s.d > p.pub_date ORDER BY s.d) END AS later_rank
  FROM phased p JOIN opened s ON s.cod = p.cod AND s.idx BETWEEN p.idx_before AND p.idx_before + 6""")
cte("tape", """SELECT w.*, ret / nullif(sd, 0) AS z, abs(ret / nullif(sd, 0)) >= 2 AS unusual, open_px / nullif(prev_ref, 0) - 1 AS gap, last / nullif(open_px, 0) - 1 AS intraday,
  ln(open_px / prev_ref) / nullif(ln(last / prev_ref), 0) AS open_share, qty / nullif(avg_qty, 0) AS vol_x,
  d < pub_date OR (timing = 'same_day' AND phase = 'after_close') AS closed_before,
  CASE WHEN phase IN ('pre_open', 'in_session') THEN timing = 'same_day' ELSE coalesce(later_rank = 1, false) END AS is_reaction,
  f.final_d, v.final_px, (v.final_px - prev_ref) / nullif(last - prev_ref, 0) AS retained
  FROM windowed w CROSS JOIN (SELECT max(d) AS final_d FROM quotes) f LEFT JOIN (SELECT cod, d AS final_d, last AS final_px FROM valid) v ON v.cod = w.cod AND v.final_d = f.final_d
  WHERE later_rank IS NULL OR later_rank <= 5""")


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def sr6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def exact(x: str, places: int) -> str:
    """A double rounded half up by its shortest decimal form, as Spark rounds, in DuckDB."""
    return f"cast(round(cast(cast({x} as varchar) as decimal(38, 14)), {places}) as double)"


def names_of(t: Tables):
    return t.once("universe", lambda: op.universe(t.names, quoted_of(t), stop=STOP))


def quoted_of(t: Tables):
    """The instruments with a quote, each with its last day, valid or not."""
    return t.once("quoted", lambda: t.quoted)


def quotes_of(t: Tables):
    """Quotes for jobs with several parts that read them, written in the order of instruments and days: so they take less room there and in the shuffles that follow, however many instruments share a task."""
    return t.once("quotes", lambda: t.quotes.sortWithinPartitions("cod", "d"))


def one_of(t: Tables):
    """(id, cod) of articles that name one company."""
    return t.once("one", lambda: op.one_company(op.match_names(op.publication(t.articles), names_of(t))))


def tape_of(t: Tables, quotes=None):
    """The tape, which reads quotes once and so takes them from the table; a job that has them written anyway hands them in."""
    final = quoted_of(t).agg(F.max("d").alias("final_d"))
    return op.tape(t.articles, names_of(t), t.quotes if quotes is None else quotes, one=one_of(t), final=final)


@query("scan_quotes_valid", "valid", f"SELECT cod, d, {sr6('last', 'ref')} FROM valid")
def _(t):
    return op.valid_quotes(t.quotes).select("cod", "d", *r6("last", "ref"))


@query("instrument_universe", "universe", "SELECT cod, name, isin FROM universe")
def _(t):
    return names_of(t).select("cod", "name", "isin")


@query("instrument_universe_loose", "loose", "SELECT cod, name, isin FROM loose")
def _(t):
    return op.universe(t.names, t.quotes).select("cod", "name", "isin")


@query("non_etf_universe", "names quotes", "SELECT cod, kind FROM names WHERE kind <> 'ETF' AND cod IN (SELECT cod FROM quotes)")
def _(t):
    return t.names.where("kind <> 'ETF'").join(t.quotes.select("cod").distinct(), "cod", "left_semi").select("cod", "kind")


@query("scan_articles_by_range", "published", "SELECT id, title, pub_date FROM published WHERE pub_date BETWEEN date '1997-01-01' AND date '1997-06-30'")
def _(t):
    return op.publication(t.articles).where("pub_date between date '1997-01-01' and date '1997-06-30'").select("id", "title", "pub_date")


@query("scan_articles_by_ids", "published matches", "SELECT id, title, pub_date FROM published WHERE id IN (SELECT id FROM matches GROUP BY id HAVING count(*) = 2)")
def _(t):
    p = op.publication(t.articles)
    two = op.match_names(p, names_of(t)).groupBy("id").count().where("count = 2")
    return p.join(two, "id", "left_semi").select("id", "title", "pub_date")


@query("exclude_live_blogs", "articles", "SELECT id, title FROM articles WHERE NOT regexp_matches(title, '^Live blog')")
def _(t):
    return t.articles.where(~F.col("title").rlike("^Live blog")).select("id", "title")


@query("publication_local", "published", "SELECT id, strftime(pub_local, '%Y-%m-%d %H:%M:%S') AS pub_local, pub_date FROM published")
def _(t):
    return op.publication(t.articles).select("id", F.date_format("pub_local", "yyyy-MM-dd HH:mm:ss").alias("pub_local"), "pub_date")


@query("dedup_session", "", """SELECT user_id, d, event_id, round(value, 6) AS value FROM (SELECT user_id, cast(ts as date) AS d, event_id, value,
  row_number() OVER (PARTITION BY user_id, cast(ts as date) ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def _(t):
    e = t.base("events").select("user_id", "ts", "event_id", "value")
    return op.latest_of_day(e, key="user_id", tie="event_id").select("user_id", "d", "event_id", *r6("value"))


@query("daily_move", "sessions", f"SELECT cod, d, idx, {sr6('ret')} FROM sessions")
def _(t):
    return op.sessions(t.quotes).select("cod", "d", F.col("idx").cast("long").alias("idx"), *r6("ret"))


@query("rolling_sd_inclusive", "sessions", "SELECT cod, d, count(ret) OVER w AS n_in, round(stddev_samp(ret) OVER w, 6) AS sd_in FROM sessions WINDOW w AS (PARTITION BY cod ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def _(t):
    return op.rolling(op.sessions(t.quotes), -19, 0, "in").select("cod", "d", "n_in", *r6("sd_in"))


@query("rolling_sd_exclusive", "sessions", "SELECT cod, d, count(ret) OVER w AS n_ex, round(stddev_samp(ret) OVER w, 6) AS sd_ex FROM sessions WINDOW w AS (PARTITION BY cod ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def _(t):
    return op.rolling(op.sessions(t.quotes), -20, -1, "ex").select("cod", "d", "n_ex", *r6("sd_ex"))


@query("z_trailing", "sessions", """SELECT cod, d, round(CASE WHEN n = 20 THEN ret / nullif(sd, 0) END, 6) AS z FROM (
  SELECT *, count(ret) OVER w AS n, stddev_samp(ret) OVER w AS sd FROM sessions WINDOW w AS (PARTITION BY cod ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
  WHERE d BETWEEN date '1996-01-01' AND date '1999-12-31'""")
def _(t):
    return op.trailing_z(op.sessions(t.quotes), "1996-01-01", "1999-12-31").select("cod", "d", *r6("z"))


@query("base_rate", "sessions names", """SELECT n_sessions_a, n_unusual_a, round(n_unusual_a / n_sessions_a, 6) AS share_a, n_sessions_b, n_unusual_b, round(n_unusual_b / n_sessions_b, 6) AS share_b FROM (
  SELECT count(*) FILTER (na = 20) AS n_sessions_a, count(*) FILTER (na = 20 AND abs(ret / nullif(sa, 0)) >= 2) AS n_unusual_a,
    count(*) FILTER (nb = 20) AS n_sessions_b, count(*) FILTER (nb = 20 AND abs(ret / nullif(sb, 0)) >= 2) AS n_unusual_b
  FROM (SELECT ret, count(ret) OVER a AS na, stddev_samp(ret) OVER a AS sa, count(ret) OVER b AS nb, stddev_samp(ret) OVER b AS sb FROM sessions
    WHERE d >= date '1996-01-01' AND ret IS NOT NULL AND cod IN (SELECT cod FROM names WHERE kind <> 'ETF')
    WINDOW a AS (PARTITION BY cod ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (PARTITION BY cod ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)))""")
def _(t):
    return op.base_rate(op.sessions(t.quotes, codes=t.names.where("kind <> 'ETF'")), start="1996-01-01").select("n_sessions_a", "n_unusual_a", *r6("share_a"), "n_sessions_b", "n_unusual_b", *r6("share_b"))


@query("name_pattern_build", "names", r"SELECT cod, '(?<![0-9A-Za-z_])S(?i:' || substr(name, 2) || ')(?![0-9A-Za-z_])' AS pattern FROM names")
def _(t):
    return t.names.select("cod", op.name_pattern("name").alias("pattern"))


@query("title_company_match", "matches", "SELECT id, cod FROM matches")
def _(t):
    return op.match_names(op.publication(t.articles), names_of(t))


@query("single_company_only", "one", "SELECT id, cod FROM one")
def _(t):
    return op.one_company(op.match_names(op.publication(t.articles), names_of(t)))


@query("asof_anchor", "anchored", "SELECT id, cod, idx_before FROM anchored")
def _(t):
    p, one = op.publication(t.articles), one_of(t)
    return op.anchor(p.join(one, "id"), op.sessions(t.quotes, codes=one)).select("id", "cod", F.col("idx_before").cast("long").alias("idx_before"))


@query("baseline_stats", "based", f"SELECT id, cod, n_base, {sr6('sd', 'avg_qty')}, base_from, base_to FROM based")
def _(t):
    p, one = op.publication(t.articles), one_of(t)
    s = op.sessions(t.quotes, codes=one)
    return op.anchor(p.join(one, "id"), op.baseline(s), carry=op.BASE).select("id", "cod", "n_base", *r6("sd", "avg_qty"), "base_from", "base_to")


@query("publication_phase", "phased", "SELECT id, cod, phase FROM phased")
def _(t):
    return tape_of(t).select("id", "cod", "phase").distinct()


@query("usable_open", "opened", f"SELECT cod, d, {sr6('open_px')} FROM opened")
def _(t):
    return op.sessions(t.quotes).select("cod", "d", F.round(op.usable_open(), 6).alias("open_px"))


TAPE = "id cod d timing later_rank closed_before is_reaction unusual".split()
TAPE6 = "z gap intraday open_share vol_x retained".split()


@query("tape_window", "tape", f"SELECT {', '.join(TAPE)}, {sr6(*TAPE6)} FROM tape")
def _(t):
    return tape_of(t).withColumn("later_rank", F.col("later_rank").cast("long")).select(*TAPE, *r6(*TAPE6))


@query("session_timing", "tape", "SELECT timing, phase, count(*) AS n FROM tape GROUP BY ALL")
def _(t):
    return tape_of(t).groupBy("timing", "phase").agg(F.count(F.lit(1)).alias("n"))


@query("closed_before_publication", "tape", "SELECT id, cod, d, closed_before FROM tape WHERE closed_before")
def _(t):
    return tape_of(t).where("closed_before").select("id", "cod", "d", "closed_before")


@query("reaction_session", "tape", "SELECT id, cod, d FROM tape WHERE is_reaction")
def _(t):
    return tape_of(t).where("is_reaction").select("id", "cod", "d")


@query("z_and_unusual", "tape", f"SELECT id, cod, d, {sr6('z')}, unusual FROM tape WHERE unusual")
def _(t):
    return tape_of(t).where("unusual").select("id", "cod", "d", *r6("z"), "unusual")


@query("retained_move", "tape", f"SELECT id, cod, d, {sr6('retained')} FROM tape WHERE final_px IS NOT NULL")
def _(t):
    return tape_of(t).where("final_px is not null").select("id", "cod", "d", *r6("retained"))


@query("final_price", "quotes valid", f"SELECT f.final_d, v.cod, {sr6('last')} FROM (SELECT max(d) AS final_d FROM quotes) f LEFT JOIN valid v ON v.d = f.final_d")
def _(t):
    f = t.quotes.agg(F.max("d").alias("final_d"))
    v = op.valid_quotes(t.quotes).select("cod", F.col("d").alias("final_d"), "last")
    return F.broadcast(f).join(v, "final_d", "left").select("final_d", "cod", *r6("last"))


@query("later_rank", "tape", "SELECT id, cod, d, later_rank FROM tape WHERE later_rank IS NOT NULL")
def _(t):
    return tape_of(t).where("later_rank is not null").select("id", "cod", "d", F.col("later_rank").cast("long").alias("later_rank"))


cte("utc", "SELECT *, cast(pub_utc as date) AS pub_date FROM articles WHERE NOT starts_with(title, 'Live blog')")
cte("peaks", """SELECT id, cod, d, ret, sd, z FROM (SELECT b.id, b.cod, s.d, s.ret, b.sd, s.ret / nullif(b.sd, 0) AS z,
    row_number() OVER (PARTITION BY b.id ORDER BY abs(s.ret / nullif(b.sd, 0)) DESC NULLS LAST, s.d) AS k
  FROM (SELECT a.*, count(s.ret) AS n_base, stddev_samp(s.ret) AS sd FROM
      (SELECT u.id, o.cod, max(s.idx) AS ib FROM utc u JOIN one o USING (id) JOIN sessions s ON s.cod = o.cod AND s.d < u.pub_date GROUP BY ALL) a
      JOIN sessions s ON s.cod = a.cod AND s.idx BETWEEN a.ib - 19 AND a.ib GROUP BY ALL) b
  JOIN sessions s ON s.cod = b.cod AND s.idx BETWEEN b.ib AND b.ib + 6 WHERE n_base = 20) WHERE k = 1""")


@query("event_window_peak", "peaks", f"SELECT id, cod, d, {sr6('ret', 'z')} FROM peaks")
def _(t):
    return op.event_peaks(t.articles, names_of(t), t.quotes).select("id", "cod", "d", *r6("ret", "z"))


@query("peak_rank", "tape", f"""SELECT id, cod, d, {sr6('z')}, k AS peak_rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(z) DESC NULLS LAST, d) AS k FROM tape) WHERE k <= 3""")
def _(t):
    w = op.Window.partitionBy("cod", "id").orderBy(F.abs("z").desc_nulls_last(), "d")
    return tape_of(t).withColumn("peak_rank", F.row_number().over(w).cast("long")).where("peak_rank <= 3").select("id", "cod", "d", *r6("z"), "peak_rank")


cte("series", """SELECT b.id, b.cod, s.d, s.last, s.ret, b.sd, s.idx - b.idx_before - 1 AS rel, s.idx BETWEEN b.idx_before - 19 AND b.idx_before AS in_baseline,
  s.last / p.last * 100 AS index_100, s.ret / nullif(b.sd, 0) AS z
  FROM based b JOIN sessions p ON p.cod = b.cod AND p.idx = b.idx_before JOIN sessions s ON s.cod = b.cod AND s.idx BETWEEN b.idx_before - 25 AND b.idx_before + 40""")


def series_of(t: Tables, **kw):
    return op.chart_series(t.articles, names_of(t), quotes_of(t), one=one_of(t), **kw)


@query("chart_series", "series", f"SELECT id, cod, d, rel, in_baseline, {sr6('index_100', 'z')} FROM series")
def _(t):
    return series_of(t).select("id", "cod", "d", F.col("rel").cast("long").alias("rel"), "in_baseline", *r6("index_100", "z"))


@query("index_100", "series", f"SELECT id, cod, d, {sr6('index_100')} FROM series WHERE rel IN (-1, 0, 5)")
def _(t):
    return series_of(t).where("rel in (-1, 0, 5)").select("id", "cod", "d", *r6("index_100"))


@query("relative_session", "series", "SELECT rel, in_baseline, count(*) AS n FROM series GROUP BY ALL")
def _(t):
    return series_of(t).groupBy(F.col("rel").cast("long").alias("rel"), "in_baseline").agg(F.count(F.lit(1)).alias("n"))


@query("scan_articles_by_range_or_ids", "published", """SELECT 'ids' AS scan, id, title, pub_date FROM published WHERE id IN (SELECT cast(o_orderkey as varchar) FROM orders WHERE o_totalprice > 400000) UNION ALL SELECT 'range', id, title, pub_date FROM published WHERE pub_date BETWEEN date '1997-01-01' AND date '1997-06-30'""")
def _(t):
    p = op.publication(t.articles)
    ids = t.base("orders").where("o_totalprice > 400000").select(F.col("o_orderkey").cast("string").alias("id"))
    scan = lambda how, x: x.select(F.lit(how).alias("scan"), "id", "title", "pub_date")
    return scan("ids", op.articles_in(p, ids=ids, start="1997-01-01", end="1997-06-30")).unionByName(scan("range", op.articles_in(p, start="1997-01-01", end="1997-06-30")))


@query("session_index", "sessions", "SELECT cod, max(idx) AS sessions, min(d) AS first_d FROM sessions GROUP BY cod")
def _(t):
    return op.sessions(t.quotes).groupBy("cod").agg(F.max("idx").cast("long").alias("sessions"), F.min("d").alias("first_d"))


@query("gap_intraday_openshare", "tape", f"SELECT id, cod, d, {sr6('gap', 'intraday', 'open_share')} FROM tape WHERE open_px IS NOT NULL")
def _(t):
    return tape_of(t).where("open_px is not null").select("id", "cod", "d", *r6("gap", "intraday", "open_share"))


@query("volume_multiple", "tape", f"SELECT id, cod, d, {sr6('vol_x')} FROM tape")
def _(t):
    return tape_of(t).select("id", "cod", "d", *r6("vol_x"))
