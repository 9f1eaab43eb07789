"""Queries over thesis evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.fixtures import Tables, cte
from tidemark.operators import evidence as op
from tidemark.operators.tape import publication, sessions
from tidemark.plans.study import matched, stories_of
from tidemark.plans.tape import quotes_of, r6
from tidemark.registry import query

cte("matched", "SELECT a.*, o.cod FROM published a JOIN one o USING (id)")
cte("quartered", "SELECT m.id, m.cod, m.title, m.pub_utc, m.pub_date, q.no, q.quarter FROM matched m JOIN quarters q ON m.pub_date BETWEEN q.from_d AND q.to_d")
cte("storied", "SELECT s.*, a.title FROM stories s JOIN published a USING (id)")
cte("thesis_words", "SELECT ticker, i AS indicator, lower(i) AS word FROM theses, unnest(indicators) AS u(i)")
cte("thesis_hits", "SELECT t.ticker, s.id, t.indicator, 1 AS hits FROM storied s JOIN thesis_words t ON t.ticker = s.cod AND list_contains(regexp_extract_all(lower(s.title), '[0-9a-z]{3,}'), t.word)")


def quartered(t: Tables):
    return op.assign_quarters(matched(t), t.quarters, date="pub_date")


def storied(t: Tables):
    return stories_of(t).join(publication(t.articles).select("id", "title"), "id")


def tags_of(t: Tables):
    """The indicator with most word hits for each story; the first by name on ties."""
    return op.top(op.thesis_hits(storied(t), t.theses), 1, ["id"], F.desc("hits"), "indicator").select("id", "indicator")


def indicators_of(t: Tables):
    return t.theses.select(F.col("ticker").alias("cod"), F.explode("indicators").alias("indicator"))


@query("quarter_assign", "quartered", "SELECT id, quarter FROM quartered")
def _(t):
    return quartered(t).select("id", "quarter")


@query("results_articles_top2", "quartered", """SELECT id, cod, quarter, place FROM (SELECT *, row_number() OVER (PARTITION BY cod, quarter ORDER BY score DESC, pub_utc, length(title) DESC, id) AS place FROM (
  SELECT *, NOT contains(title, 'LOW') AS real, bool_or(NOT contains(title, 'LOW')) OVER (PARTITION BY cod, quarter) AS any_real, CASE WHEN contains(title, 'HIGH') THEN 2 WHEN contains(title, 'URGENT') THEN 1 ELSE 0 END AS score FROM quartered) WHERE real OR NOT any_real) WHERE place <= 2""")
def _(t):
    title = F.col("title")
    score = F.when(title.contains("HIGH"), 2).when(title.contains("URGENT"), 1).otherwise(0)
    x = quartered(t).withColumn("size", F.length("title"))
    return op.results_candidates(x, keys=["cod", "quarter"], preview=title.contains("LOW"), score=score, at="pub_utc", size="size").select("id", "cod", "quarter", "place")


@query("headlines_top40", "matched", "SELECT id, cod, place FROM (SELECT *, row_number() OVER (PARTITION BY cod ORDER BY pub_utc DESC, id) AS place FROM matched) WHERE place <= 40")
def _(t):
    return op.top(matched(t), 40, ["cod"], F.desc("pub_utc"), "id").select("id", "cod", "place")


cte("on_or_before", "SELECT q.id, q.cod, p.pub_local, s.idx FROM quartered q JOIN published p USING (id) ASOF JOIN sessions s ON s.cod = q.cod AND s.d <= q.pub_date")


@query("results_reaction", "on_or_before", """SELECT o.id, o.cod, round(CASE WHEN strftime(o.pub_local, '%H:%M:%S') < '17:30:00' THEN n.last / nullif(b.last, 0) ELSE a.last / nullif(n.last, 0) END - 1, 6) AS move FROM on_or_before o
  JOIN sessions n ON n.cod = o.cod AND n.idx = o.idx LEFT JOIN sessions b ON b.cod = o.cod AND b.idx = o.idx - 1 LEFT JOIN sessions a ON a.cod = o.cod AND a.idx = o.idx + 1""")
def _(t):
    x = op.results_reaction(quartered(t), sessions(t.quotes))
    return x.select("id", "cod", *r6("move"))


@query("thesis_title_match", "thesis_hits", "SELECT ticker, id, indicator, hits FROM thesis_hits")
def _(t):
    return op.thesis_hits(storied(t), t.theses)


@query("best_indicator_tag", "thesis_hits", "SELECT id, min(indicator) AS indicator FROM thesis_hits GROUP BY id")
def _(t):
    return tags_of(t)


@query("apply_indicator_tags", "thesis_hits theses", "SELECT id, indicator FROM (SELECT id, min(indicator) AS indicator FROM thesis_hits GROUP BY id) WHERE indicator IN ('URGENT', 'MEDIUM')")
def _(t):
    allowed = t.spark.createDataFrame([("URGENT",), ("MEDIUM",)], "indicator string")
    return tags_of(t).join(F.broadcast(allowed), "indicator", "left_semi").select("id", "indicator")


cte("tagged", """SELECT s.*, CASE WHEN h.indicator IS NULL THEN 'outside' ELSE h.indicator END AS bucket FROM storied s LEFT JOIN (SELECT id, min(indicator) AS indicator FROM thesis_hits GROUP BY id) h USING (id)""")


@query("news_rollup", "tagged", """SELECT cod, bucket, count(*) AS n, count(*) FILTER (status IN ('REACTED', 'DELAYED')) AS n_reaction, count(*) FILTER (status IN ('ALREADY_IN_PRICE', 'PARTLY_IN_PRICE', 'MOSTLY_AT_OPEN')) AS n_already,
  count(*) FILTER (status = 'NO_REACTION') AS n_none, string_agg(id, ',' ORDER BY k) FILTER (k <= 5) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY cod, bucket ORDER BY pub_local DESC, id) AS k FROM tagged) GROUP BY cod, bucket""")
def _(t):
    return op.news_rollup(storied(t), tags_of(t), indicators_of(t))


@query("news_by_indicator", "tagged theses", """SELECT g.cod, g.bucket, count(t.id) AS n, count(t.id) FILTER (status IN ('REACTED', 'DELAYED')) AS n_reaction, count(t.id) FILTER (status IN ('ALREADY_IN_PRICE', 'PARTLY_IN_PRICE', 'MOSTLY_AT_OPEN')) AS n_already, count(t.id) FILTER (status = 'NO_REACTION') AS n_none,
  count(t.id) FILTER (status <> 'NO_REACTION' AND peak_ret > 0) AS up, count(t.id) FILTER (status <> 'NO_REACTION' AND peak_ret < 0) AS down FROM (SELECT ticker AS cod, unnest(list_append(indicators, 'outside')) AS bucket FROM theses) g LEFT JOIN tagged t USING (cod, bucket) GROUP BY g.cod, g.bucket""")
def _(t):
    return op.news_by_indicator(storied(t), tags_of(t), indicators_of(t))


cte("votes", """SELECT cod, count(*) FILTER (status IN ('REACTED', 'DELAYED') AND peak_ret > 0) AS pros, count(*) FILTER (status IN ('REACTED', 'DELAYED') AND peak_ret < 0) AS cons FROM stories GROUP BY cod""")
VOTE = "CASE WHEN pros > 0 AND cons = 0 THEN 'strengthened' WHEN cons > 0 AND pros = 0 THEN 'weakened' WHEN pros = 0 AND cons = 0 THEN 'insufficient' ELSE 'unchanged' END"


def votes_of(t: Tables):
    moved = F.col("status").isin("REACTED", "DELAYED")
    return stories_of(t).groupBy("cod").agg(F.count_if(moved & (F.col("peak_ret") > 0)).alias("pros"), F.count_if(moved & (F.col("peak_ret") < 0)).alias("cons"))


def overall():
    return F.expr("CASE WHEN pros > 0 AND cons = 0 THEN 'strengthened' WHEN cons > 0 AND pros = 0 THEN 'weakened' WHEN pros = 0 AND cons = 0 THEN 'insufficient' ELSE 'unchanged' END")


@query("overall_vote", "votes", f"SELECT cod, pros, cons, {VOTE} AS vote FROM votes")
def _(t):
    return votes_of(t).withColumn("vote", overall())


ACTIONS = [("portfolio", "strengthened", "add"), ("portfolio", "weakened", "reduce"), ("portfolio", "unchanged", "hold"), ("portfolio", "insufficient", "review"), ("watchlist", "strengthened", "open"), ("watchlist", "weakened", "drop"), ("watchlist", "unchanged", "watch"), ("watchlist", "insufficient", "watch")]


@query("action_mapping", "votes positions", f"""SELECT v.cod, a.action FROM (SELECT cod, {VOTE} AS vote, CASE WHEN cod IN (SELECT ticker FROM positions) THEN 'portfolio' ELSE 'watchlist' END AS context FROM votes) v
  JOIN (VALUES {', '.join(str(a) for a in ACTIONS)}) AS a(context, vote, action) USING (context, vote)""")
def _(t):
    held = t.positions.select(F.col("ticker").alias("cod"), F.lit(True).alias("held"))
    v = votes_of(t).withColumn("vote", overall()).join(held, "cod", "left").withColumn("context", F.when(F.col("held"), "portfolio").otherwise("watchlist"))
    a = t.spark.createDataFrame(ACTIONS, "context string, vote string, action string")
    return v.join(F.broadcast(a), ["context", "vote"]).select("cod", "action")


@query("earliest_anchor", "quartered", "SELECT cod, quarter, id FROM (SELECT *, row_number() OVER (PARTITION BY cod, quarter ORDER BY pub_utc, id) AS k FROM quartered WHERE contains(title, 'HIGH')) WHERE k = 1")
def _(t):
    x = quartered(t).where(F.col("title").contains("HIGH")).groupBy("cod", "quarter").agg(F.min(F.struct("pub_utc", "id")).alias("x"))
    return x.select("cod", "quarter", "x.id")


@query("facts_top4", "storied thesis_hits", """SELECT cod, id, place FROM (SELECT *, row_number() OVER (PARTITION BY cod ORDER BY pub_local DESC, id) AS place FROM (
  SELECT *, id IN (SELECT id FROM thesis_hits) AS hit, bool_or(id IN (SELECT id FROM thesis_hits)) OVER (PARTITION BY cod) AS any_real FROM storied) WHERE hit OR NOT any_real) WHERE place <= 4""")
def _(t):
    s = storied(t)
    x = s.join(op.thesis_hits(s, t.theses).select("id", F.lit(True).alias("hit")).distinct(), "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    x = x.withColumn("some", F.max("hit").over(Window.partitionBy("cod"))).where("hit or not some")
    return op.top(x, 4, ["cod"], F.desc("pub_local"), "id").select("cod", "id", "place")


FIELDS = ["motive", "indicators", "horizon", "target_weight"]
cte("old_new", "SELECT n.ticker, b.ticker IS NOT NULL AS known, n.motive IS NOT DISTINCT FROM b.motive AND n.indicators IS NOT DISTINCT FROM b.indicators AND n.horizon IS NOT DISTINCT FROM b.horizon AND n.target_weight IS NOT DISTINCT FROM b.target_weight AS same FROM theses n LEFT JOIN theses_before b USING (ticker)")


@query("incremental_skip", "old_new", "SELECT ticker FROM old_new WHERE NOT known OR NOT same OR cast(substr(ticker, 2) as bigint) % 7 = 0")
def _(t):
    # a seventh of the state was built by the version before
    old = F.substring("ticker", 2, 12).cast("long") % 7 == 0
    built = op.fingerprinted(t.theses_before.where(~old), FIELDS, version="2").unionByName(op.fingerprinted(t.theses_before.where(old), FIELDS, version="1"))
    return op.changed_only(op.fingerprinted(t.theses, FIELDS, version="2"), built, key="ticker", fingerprint="fp").select("ticker")


@query("thesis_staleness", "old_new", "SELECT ticker, NOT same AS stale FROM old_new WHERE known")
def _(t):
    s = lambda p: F.struct(*[F.col(f"{p}.{c}") for c in FIELDS])
    return t.theses.alias("n").join(t.theses_before.alias("u"), "ticker").select("ticker", (~s("n").eqNullSafe(s("u"))).alias("stale"))


@query("override_theses", "theses overrides", "SELECT t.ticker, CASE WHEN o.has_motive THEN o.motive ELSE t.motive END AS motive, t.horizon, CASE WHEN o.has_weight THEN o.target_weight ELSE t.target_weight END AS target_weight FROM theses t LEFT JOIN overrides o USING (ticker)")
def _(t):
    # a map of the fields that an override names; a field named with null overrides too
    pairs = F.filter(F.array(F.struct(F.lit("motive").alias("k"), F.col("motive").alias("v"), F.col("has_motive").alias("on")), F.struct(F.lit("target_weight").alias("k"), F.col("target_weight").cast("string").alias("v"), F.col("has_weight").alias("on"))), lambda x: x["on"])
    named = t.overrides.select("ticker", F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["k"], x["v"]))).alias("fields"))
    return op.overridden(t.theses, named, "ticker", ["motive", "horizon", "target_weight"]).select("ticker", "motive", "horizon", "target_weight")


BEFORE = "SELECT cod, indicator_1 AS name, state_1 AS state FROM concluded UNION ALL SELECT cod, indicator_2, state_2 FROM concluded"
cte("indicators_before", BEFORE)


@query("recalc_diff", "overall concluded indicators_before best_claims thesis_names", """SELECT o.cod, CASE WHEN coalesce(c.status, '') <> coalesce(o.state, '') THEN concat(coalesce(c.status, '-'), '>', coalesce(o.state, '-')) END AS status, CASE WHEN coalesce(c.action, '') <> coalesce(o.action, '') THEN concat(coalesce(c.action, '-'), '>', o.action) END AS decision,
  coalesce(i.indicators, '') AS indicators, trim(coalesce(c.summary, '')) <> trim(o.summary) AS summary_changed FROM overall o JOIN concluded c USING (cod) LEFT JOIN (
    SELECT cod, string_agg(name || ':' || coalesce(before, '-') || '>' || state, ',' ORDER BY name) AS indicators FROM (SELECT n.cod, n.name, b.state AS before, coalesce(k.state, 'not_cited') AS state FROM thesis_names n LEFT JOIN indicators_before b USING (cod, name)
      LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cod, name ORDER BY no DESC) AS k FROM best_claims WHERE kind = 'indicator' AND ok AND state <> 'not_cited' AND quote IS NOT NULL) k ON k.k = 1 AND k.cod = n.cod AND k.name = n.name) WHERE before IS DISTINCT FROM state GROUP BY cod) i USING (cod)""")
def _(t):
    from tidemark.operators.theses import latest_cited
    from tidemark.plans.theses import best_of

    after = t.overall.select("cod", F.col("state").alias("status"), "action", "summary")
    states = F.array(*[F.struct(F.col(f"indicator_{i}").alias("name"), F.col(f"state_{i}").alias("state")) for i in (1, 2)])
    was = t.concluded.select("cod", F.inline(states))
    now = latest_cited(best_of(t), t.theses).select("cod", F.col("indicator").alias("name"), "state")
    return op.recalc_diff(t.concluded.select("cod", "status", "action", "summary"), after, was, now)


#: How the price since the last results reads against the thesis: state, direction, reading.
READINGS = [
    ("strengthened", "up", "with_thesis"), ("strengthened", "down", "not_yet_reflected"), ("strengthened", "flat", "still_despite_stronger"),
    ("weakened", "down", "confirms_weakening"), ("weakened", "up", "rises_despite_weaker"), ("weakened", "flat", "still_despite_weaker"),
    ("unchanged", "up", "risen_thesis_unchanged"), ("unchanged", "down", "fallen_thesis_unchanged"), ("unchanged", "flat", "both_still"),
]
cte("readings", f"SELECT * FROM (VALUES {', '.join(map(str, READINGS))}) AS r(vote, dir, reading)")
cte("since_results", """SELECT r.cod, (l.close / nullif(s.last, 0) - 1) * 100 AS pct FROM (SELECT cod, max(cast(pub_local as date)) AS day FROM storied WHERE contains(title, 'HIGH') GROUP BY cod) r
  ASOF JOIN sessions s ON s.cod = r.cod AND s.d < r.day JOIN (SELECT cod, arg_max(last, idx) AS close FROM sessions GROUP BY cod) l ON l.cod = r.cod""")


@query("price_vs_thesis", "votes since_results readings", f"""SELECT v.cod, coalesce(r.reading, 'insufficient') AS reading FROM (SELECT v.cod, {VOTE} AS vote, CASE WHEN pct > 0.5 THEN 'up' WHEN pct < -0.5 THEN 'down' WHEN pct IS NOT NULL THEN 'flat' END AS dir
  FROM votes v LEFT JOIN since_results s USING (cod)) v LEFT JOIN readings r USING (vote, dir)""")
def _(t):
    s = sessions(quotes_of(t))
    r = storied(t).where(F.col("title").contains("HIGH")).groupBy("cod").agg(F.max(F.to_date("pub_local")).alias("pub_date"))
    since = op.since(r, s).select("cod", (F.col("change") * 100).alias("pct"))
    grid = t.spark.createDataFrame(READINGS, "vote string, dir string, reading string")
    d = F.when(F.col("pct") > 0.5, "up").when(F.col("pct") < -0.5, "down").when(F.col("pct").isNotNull(), "flat")
    x = votes_of(t).withColumn("vote", overall()).join(since, "cod", "left").withColumn("dir", d)
    return x.join(F.broadcast(grid), ["vote", "dir"], "left").select("cod", F.coalesce("reading", F.lit("insufficient")).alias("reading"))


#: Words by which a title announces results, and words of results.
PREVIEW = r"\b(?:attesi|attesa|attese|in vista dei conti|in attesa dei|prima dei conti|verso i conti|le stime|si aspettano|il [0-9]{1,2} [a-z]+ i conti|low)\b"
RESULTS = "trimestre|semestre|conti|risultati|ricavi|utile|utili|bilancio|ebitda|guidance|trimestrale|urgent|high|medium"


@query("preview_title", "quartered", f"SELECT id, regexp_matches(lower(title), '{PREVIEW}') AS preview FROM quartered")
def _(t):
    return quartered(t).select("id", F.lower("title").rlike(PREVIEW).alias("preview"))


@query("results_score", "quartered names", f"SELECT q.id, len(regexp_extract_all(lower(q.title), '\\b(?:{RESULTS})\\b')) + CASE WHEN starts_with(lower(q.title), lower(n.name)) THEN 2 ELSE 0 END + CASE WHEN cast(q.id as bigint) % 5 = 0 THEN 1 ELSE 0 END AS score FROM quartered q JOIN names n USING (cod)")
def _(t):
    x = quartered(t).join(t.names.select("cod", "name"), "cod").withColumn("own", F.col("id").cast("long") % 5 == 0)  # a fifth comes from the company's own file
    return x.select("id", op.results_score("title", "name", "own", RESULTS).alias("score"))
