"""Queries over portfolio, feeds, exports and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.fixtures import Tables, cte
from tidemark.operators import desk as op
from tidemark.operators import tape as tp
from tidemark.operators.events import STATUSES
from tidemark.operators.evidence import since
from tidemark.plans.evidence import storied
from tidemark.plans.study import stories_of
from tidemark.plans.tape import exact, one_of, quotes_of, r6, sr6
from tidemark.registry import query

cte("lastpx", "SELECT cod, d, last AS close, coalesce(ret, 0) AS move FROM (SELECT *, row_number() OVER (PARTITION BY cod ORDER BY idx DESC) AS k FROM sessions) WHERE k = 1")
cte("book", "SELECT p.ticker, p.qty, l.close, l.move, p.qty * l.close AS value FROM positions p JOIN lastpx l ON l.cod = p.ticker")


def last_of(t: Tables):
    return op.last_close_and_move(tp.sessions(t.quotes))


def book_of(t: Tables):
    last = last_of(t)
    return op.values(t.positions, last).join(last.select(F.col("cod").alias("ticker"), "move"), "ticker")


@query("last_close_and_move", "lastpx", f"SELECT cod, d, {sr6('close', 'move')} FROM lastpx")
def _(t):
    return last_of(t).select("cod", "d", *r6("close", "move"))


@query("holding_weights", "book", "SELECT ticker, round(value / sum(value) OVER () * 100, 6) AS weight FROM book")
def _(t):
    b = book_of(t)
    return b.crossJoin(F.broadcast(b.agg(F.sum("value").alias("total")))).select("ticker", F.round(F.col("value") / F.col("total") * 100, 6).alias("weight"))


@query("largest_remainder_weights", "book", """SELECT ticker, cast(f + CASE WHEN row_number() OVER (ORDER BY round(u - f, 9) DESC, ticker) <= 1000 - sum(f) OVER () THEN 1 ELSE 0 END as bigint) AS units FROM (SELECT *, floor(u) AS f FROM (SELECT ticker, value / sum(value) OVER () * 1000 AS u FROM book))""")
def _(t):
    return op.largest_remainder(book_of(t)).select("ticker", "units")


@query("holding_allocation", "book", "SELECT label, round(sum(value), 4) AS value FROM (SELECT CASE WHEN row_number() OVER (ORDER BY value DESC, ticker) <= 6 THEN ticker ELSE 'other' END AS label, value FROM book) GROUP BY label")
def _(t):
    return op.bucketed(book_of(t), "ticker", 6).select(F.col("ticker").alias("label"), F.round("value", 4).alias("value"))


@query("sector_allocation", "book members", """SELECT sector, round(sum(value), 4) AS value FROM (SELECT CASE WHEN k <= 4 OR n <= 5 THEN sector ELSE 'other' END AS sector, value FROM (
  SELECT sector, value, row_number() OVER (ORDER BY value DESC, sector) AS k, count(*) OVER () AS n FROM (SELECT m.sector, sum(value) AS value FROM book b JOIN members m ON m.cod = b.ticker GROUP BY m.sector))) GROUP BY sector""")
def _(t):
    b = book_of(t).join(t.members, F.col("ticker") == F.col("cod"))
    return op.bucketed(b, "sector", 4, most=5).select("sector", F.round("value", 4).alias("value"))


@query("day_change", "book", "SELECT round(sum(value) - sum(value / (1 + move)), 4) AS change, round((sum(value) / sum(value / (1 + move)) - 1) * 100, 6) AS pct FROM book")
def _(t):
    before = F.sum(F.col("value") / (1 + F.col("move")))
    return book_of(t).agg(F.round(F.sum("value") - before, 4).alias("change"), F.round((F.sum("value") / before - 1) * 100, 6).alias("pct"))


cte("calendar", "SELECT DISTINCT d FROM valid")
cte("aligned", """SELECT g.cod, g.d, last_value(s.last IGNORE NULLS) OVER (PARTITION BY g.cod ORDER BY g.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close,
  first_value(s.last IGNORE NULLS) OVER (PARTITION BY g.cod ORDER BY g.d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead
  FROM (SELECT c.cod, k.d FROM (SELECT DISTINCT cod FROM sessions) c CROSS JOIN calendar k) g LEFT JOIN sessions s ON s.cod = g.cod AND s.d = g.d""")


def aligned(t: Tables, lead: bool):
    s = tp.sessions(t.quotes)
    return op.align(s, s.select("d").distinct(), lead=lead)


@query("calendar_align", "aligned", "SELECT cod, d, round(coalesce(close, ahead), 6) AS close FROM aligned")
def _(t):
    return aligned(t, True).select("cod", "d", *r6("close"))


@query("calendar_align_no_lead", "aligned", "SELECT cod, count(close) AS n, count(*) - count(close) AS missing FROM aligned GROUP BY cod")
def _(t):
    return aligned(t, False).groupBy("cod").agg(F.count("close").alias("n"), (F.count(F.lit(1)) - F.count("close")).alias("missing"))


#: Ranges of the value series, in days; all of them for MAX.
RANGES = {"1M": 21, "3M": 63, "1Y": 252, "MAX": None}
cte("worth", "SELECT d, sum(cast(cast(p.qty * coalesce(a.close, a.ahead) as varchar) as decimal(28, 8))) AS value, row_number() OVER (ORDER BY d DESC) AS back FROM aligned a JOIN positions p ON p.ticker = a.cod GROUP BY d")


@query("portfolio_value_series", "worth", f"""SELECT range, d, cast(round(value, 2) as double) AS value, cast(round(z - a, 2) as double) AS change, round(coalesce((cast(z as double) / nullif(cast(a as double), 0) - 1) * 100, 0), 6) AS pct FROM (
  SELECT r.range, w.d, w.value, first_value(value) OVER (PARTITION BY r.range ORDER BY d) AS a, first_value(value) OVER (PARTITION BY r.range ORDER BY d DESC) AS z FROM worth w JOIN (VALUES {', '.join(f"('{k}', {n or 2**31 - 1})" for k, n in RANGES.items())}) AS r(range, n) ON w.back <= r.n)""")
def _(t):
    x = op.value_series(t.positions, tp.sessions(t.quotes), RANGES)
    return x.select("range", "d", *[F.round(c, 2).cast("double").alias(c) for c in ("value", "change")], *r6("pct"))


@query("feed_scope_counts", "stories positions watchlist", """SELECT count(*) FILTER (h) AS held, count(*) FILTER (w) AS watched, count(*) FILTER (h OR w) AS tracked, count(*) AS n FROM (
  SELECT cod IN (SELECT ticker FROM positions) AS h, cod IN (SELECT ticker FROM watchlist) AS w FROM stories)""")
def _(t):
    h = t.positions.select(F.col("ticker").alias("cod"), F.lit(True).alias("h"))
    w = t.watchlist.select(F.col("ticker").alias("cod"), F.lit(True).alias("w"))
    x = stories_of(t).join(h, "cod", "left").join(w, "cod", "left").select(F.coalesce("h", F.lit(False)).alias("h"), F.coalesce("w", F.lit(False)).alias("w"))
    return x.agg(F.count_if("h").alias("held"), F.count_if("w").alias("watched"), F.count_if(F.col("h") | F.col("w")).alias("tracked"), F.count(F.lit(1)).alias("n"))


@query("sector_news_top3", "stories members", "SELECT sector, id FROM (SELECT m.sector, s.id, row_number() OVER (PARTITION BY m.sector ORDER BY s.pub_local DESC, s.id) AS k FROM stories s JOIN members m USING (cod)) WHERE k <= 3")
def _(t):
    w = Window.partitionBy("sector").orderBy(F.desc("pub_local"), "id")
    return stories_of(t).join(t.members, "cod").withColumn("k", F.row_number().over(w)).where("k <= 3").select("sector", "id")


@query("since_last_results", "storied sessions lastpx", """SELECT r.cod, round(l.close / nullif(s.last, 0) - 1, 6) AS change FROM (SELECT cod, max(cast(pub_local as date)) AS day FROM storied WHERE contains(title, 'HIGH') GROUP BY cod) r
  ASOF JOIN sessions s ON s.cod = r.cod AND s.d < r.day JOIN lastpx l ON l.cod = r.cod""")
def _(t):
    s = tp.sessions(quotes_of(t))
    r = storied(t).where(F.col("title").contains("HIGH")).groupBy("cod").agg(F.max(F.to_date("pub_local")).alias("pub_date"))
    return since(r, s).select("cod", *r6("change"))


@query("signal_board", "stories", """SELECT ticker, round(signal, 6) AS signal FROM (SELECT cod AS ticker, avg(sign(peak_ret) * least(1.0, abs(peak_z) / 6) * sim) AS signal FROM (SELECT *, 0.5 + (cast(id as bigint) % 50) / 100 AS sim FROM stories) WHERE sim >= 0.6 GROUP BY cod) ORDER BY round(abs(signal), 9) DESC, ticker LIMIT 10""")
def _(t):
    x = stories_of(t).select(F.col("cod").alias("ticker"), F.signum("peak_ret").alias("sign"), F.least(F.lit(1.0), F.abs("peak_z") / 6).alias("strength"), (0.5 + (F.col("id").cast("long") % 50) / 100).alias("sim"))
    return op.signal(x).select("ticker", *r6("signal"))


@query("ticker_alias", "names", "SELECT cod, CASE cod WHEN 'S1' THEN 'ONE' WHEN 'S2' THEN 'TWO' ELSE cod END AS desk FROM names")
def _(t):
    a = t.spark.createDataFrame([("S1", "ONE"), ("S2", "TWO")], "cod string, alias string")
    return t.names.join(F.broadcast(a), "cod", "left").select("cod", F.coalesce("alias", "cod").alias("desk"))


@query("card_overlay", "", """SELECT coalesce(a.id, b.id, c.id) AS id, coalesce(a.text, b.text, c.text) AS text FROM (SELECT l_orderkey AS id, 'en' AS text FROM lineitem WHERE l_linenumber = 5) a
  FULL JOIN (SELECT l_orderkey AS id, 'it' AS text FROM lineitem WHERE l_linenumber = 3) b ON a.id = b.id FULL JOIN (SELECT DISTINCT o_orderkey AS id, 'plain' AS text FROM orders WHERE o_orderkey % 3 = 0) c ON coalesce(a.id, b.id) = c.id""")
def _(t):
    li = t.base("lineitem")
    layer = lambda n, s: li.where(F.col("l_linenumber") == n).select(F.col("l_orderkey").alias("id"), F.lit(s).alias("text"))
    return op.overlay(layer(5, "en"), layer(3, "it"), t.base("orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("plain").alias("text")).distinct())


@query("detail_precedence", "stories", "SELECT id, CASE WHEN status = 'REACTED' THEN 'detail' ELSE 'history' END AS origin FROM stories")
def _(t):
    s = stories_of(t)
    return op.first_of(s.where("status = 'REACTED'").select("id", F.lit("detail").alias("origin")), s.select("id", F.lit("history").alias("origin")), "id")


def feed(t: Tables):
    s = stories_of(t)
    tracked = t.positions.select(F.col("ticker").alias("cod"))
    main = s.join(tracked, "cod", "left_semi").select("id", F.lit("tracked").alias("origin"))
    return op.first_of(main, s.where("status <> 'NO_REACTION'").select("id", F.lit("detail").alias("origin")), "id")


FEED = "SELECT id, CASE WHEN cod IN (SELECT ticker FROM positions) THEN 'tracked' ELSE 'detail' END AS origin FROM stories WHERE cod IN (SELECT ticker FROM positions) OR status <> 'NO_REACTION'"


@query("feed_union", "stories positions", FEED)
def _(t):
    return feed(t)


@query("feed_disjoint_union", "stories positions", f"SELECT origin, count(*) AS n FROM ({FEED}) GROUP BY origin")
def _(t):
    return feed(t).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("codes_union", "one names", "SELECT cod FROM one UNION SELECT cod FROM names WHERE kind = 'ETF'")
def _(t):
    return one_of(t).select("cod").union(t.names.where("kind = 'ETF'").select("cod")).distinct()


@query("price_extract_codes", "one names quotes", "SELECT cod, count(*) AS n FROM quotes WHERE cod IN (SELECT cod FROM one UNION SELECT cod FROM names WHERE kind = 'ETF') GROUP BY cod")
def _(t):
    codes = one_of(t).select("cod").union(t.names.where("kind = 'ETF'").select("cod")).distinct()
    return t.quotes.join(codes, "cod", "left_semi").groupBy("cod").agg(F.count(F.lit(1)).alias("n"))


@query("story_ids_union", "stories one anchored", "SELECT id FROM stories UNION SELECT id FROM anchored UNION SELECT id FROM one")
def _(t):
    p, one = tp.publication(t.articles), one_of(t)
    return stories_of(t).select("id").union(tp.anchor(p.join(one, "id"), tp.sessions(t.quotes, codes=one)).select("id")).union(one.select("id")).distinct()


@query("last_quote_flag_exists", "names sessions", "SELECT cod, cod IN (SELECT cod FROM sessions) AS has_prices FROM names")
def _(t):
    s = tp.valid_quotes(t.quotes).select("cod").distinct().withColumn("p", F.lit(True))
    return t.names.join(s, "cod", "left").select("cod", F.coalesce("p", F.lit(False)).alias("has_prices"))


#: A bundle with faults of every kind planted by number: stories, their details and companies, in both engines' SQL.
BUNDLE = {
    "b_stories": """SELECT id, CASE WHEN k % 101 = 0 THEN 'NOWHERE' ELSE cod END AS cod, CASE WHEN k % 103 = 0 THEN 'ODD' ELSE status END AS status, (status <> 'NO_REACTION') <> (k % 107 = 0) AS has_series, CASE WHEN k % 109 = 0 THEN cast('NaN' as double) ELSE peak_z END AS z
  FROM (SELECT *, cast(id as bigint) AS k FROM stories) AS s CROSS JOIN (VALUES (1), (2)) AS c(copy) WHERE copy = 1 OR k % 113 = 0""",
    "b_details": """SELECT id, status, CASE WHEN status <> 'NO_REACTION' THEN array(peak_z, CASE WHEN k % 137 = 0 THEN cast('Infinity' as double) ELSE 0.0 END) END AS series FROM (SELECT *, cast(id as bigint) AS k FROM stories) AS s WHERE k % 127 <> 0
  UNION ALL SELECT concat('x', id), status, array(1.5) FROM stories WHERE cast(id as bigint) % 131 = 0""",
    "b_companies": """SELECT cod, n + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS n_stories, none, n - none - CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS moved, k % 13 <> 0 AS has_prices, k % 19 = 0 AS no_prices, k % 17 = 0 AS short, k % 5 = 0 AS unbounded
  FROM (SELECT cod, cast(substr(cod, 2) as bigint) AS k, count(*) AS n, count(*) FILTER (WHERE status = 'NO_REACTION') AS none FROM stories GROUP BY cod) AS c""",
}
for _name, _text in BUNDLE.items():
    cte(_name, _text.replace("array(", "list_value("))
FINITE = "(isnan({0}) OR isinf({0}))"


@query("integrity_checks", "b_stories b_details b_companies", f"""SELECT rule, id FROM (
  SELECT 'duplicate_story' AS rule, id FROM b_stories GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'story_without_detail', id FROM b_stories WHERE id NOT IN (SELECT id FROM b_details) UNION ALL SELECT 'detail_without_story', id FROM b_details WHERE id NOT IN (SELECT id FROM b_stories)
  UNION ALL SELECT DISTINCT 'story_without_company', id FROM b_stories WHERE cod NOT IN (SELECT cod FROM b_companies) UNION ALL SELECT DISTINCT 'unknown_status', id FROM b_stories WHERE status NOT IN ({', '.join(f"'{x}'" for x in STATUSES)})
  UNION ALL SELECT DISTINCT 'status_differs', id FROM b_stories s JOIN b_details d USING (id) WHERE s.status <> d.status UNION ALL SELECT DISTINCT 'series_flag', id FROM b_stories s JOIN b_details d USING (id) WHERE s.has_series <> (d.series IS NOT NULL)
  UNION ALL SELECT 'not_finite', id FROM (SELECT id FROM b_stories WHERE {FINITE.format('z')} UNION SELECT id FROM b_details WHERE len(list_filter(series, lambda v: {FINITE.format('v')})) > 0)
  UNION ALL SELECT 'company_count', cod FROM b_companies c LEFT JOIN (SELECT cod, count(*) AS n FROM b_stories GROUP BY cod) s USING (cod) WHERE n_stories <> coalesce(n, 0) UNION ALL SELECT 'company_summary', cod FROM b_companies WHERE none + moved <> n_stories
  UNION ALL SELECT 'price_flag', cod FROM b_companies WHERE has_prices = no_prices UNION ALL SELECT 'array_lengths', cod FROM b_companies WHERE short AND NOT no_prices UNION ALL SELECT 'not_finite', cod FROM b_companies WHERE unbounded AND NOT no_prices
  UNION ALL SELECT 'manifest_count', 'companies')""")
def _(t):
    stories = stories_of(t)
    s, d, c = (t.spark.sql(text.replace("FROM stories", "FROM {stories}"), stories=stories) for text in BUNDLE.values())
    prices = F.struct(F.array(F.lit("d1"), F.lit("d2")).alias("d"), F.when(F.col("short"), F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.when(F.col("unbounded"), float("inf")).otherwise(2.0))).alias("close"))
    prices = F.when(~F.col("no_prices"), F.when(F.col("short") & F.col("unbounded"), F.struct(F.array(F.lit("d1"), F.lit("d2")).alias("d"), F.array(F.lit(float("inf"))).alias("close"))).otherwise(prices))
    counts = F.create_map(F.lit("NO_REACTION"), F.col("none"), F.lit("REACTED"), F.col("moved"))
    companies = c.select("cod", "n_stories", counts.alias("counts"), "has_prices", prices.alias("prices"))
    return op.integrity(s, d, companies, list(STATUSES), {"stories": s.count(), "companies": companies.count() + 1})


@query("write_company_columns", "sessions", f"SELECT cod, list(strftime(d, '%Y-%m-%d') ORDER BY d) AS d, list({exact(exact('last', 8), 4)} ORDER BY d) AS close, list(round(qty, 0) ORDER BY d) AS volume, list({exact('ret * 100', 2)} ORDER BY d) AS move_pct, list({exact('z', 2)} ORDER BY d) AS z FROM (SELECT *, CASE WHEN n = 20 THEN ret / nullif(sd, 0) END AS z FROM (SELECT *, count(ret) OVER w AS n, stddev_samp(ret) OVER w AS sd FROM sessions WINDOW w AS (PARTITION BY cod ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))) GROUP BY cod")
def _(t):
    return op.company_columns(tp.trailing_z(tp.sessions(t.quotes), "1000-01-01", "9999-12-31"))


@query("manifest_counts", "stories classified names lastpx", """SELECT count(*) AS n_stories, count(DISTINCT s.cod) AS n_companies, count(*) FILTER (status <> 'NO_REACTION') AS n_unusual, count(peak_d) AS n_peak, count(*) FILTER (peak_d IS NOT NULL) AS with_series, count(*) FILTER (c.news_type <> 'other') AS with_type,
  count(DISTINCT s.cod) FILTER (l.cod IS NOT NULL) AS with_prices, strftime(min(pub_local), '%Y-%m-%d') AS first_day, strftime(max(pub_local), '%Y-%m-%d') AS last_day, strftime(max(l.d), '%Y-%m-%d') AS last_price_day FROM stories s LEFT JOIN classified c USING (id) LEFT JOIN lastpx l ON l.cod = s.cod""")
def _(t):
    from tidemark.plans.text import classified

    day = lambda f, c: F.date_format(f(c), "yyyy-MM-dd")
    s = stories_of(t).join(classified(t).select("id", "news_type"), "id", "left").join(last_of(t).select("cod", "d"), "cod", "left")
    return s.agg(
        F.count(F.lit(1)).alias("n_stories"), F.count_distinct("cod").alias("n_companies"), F.count_if(F.col("status") != "NO_REACTION").alias("n_unusual"), F.count("peak_d").alias("n_peak"), F.count_if(F.col("peak_d").isNotNull()).alias("with_series"),
        F.count_if(F.col("news_type") != "other").alias("with_type"), F.count_distinct(F.when(F.col("d").isNotNull(), F.col("cod"))).alias("with_prices"), day(F.min, "pub_local").alias("first_day"), day(F.max, "pub_local").alias("last_day"), day(F.max, "d").alias("last_price_day"))


def cards_of(t: Tables):
    """A card for each matched article with the block that the rules for titles give it."""
    from tidemark.plans.text import classified

    one = one_of(t)
    return classified(t).join(one, "id").select("id", "cod", F.struct("news_type", F.lit("keyword").alias("classifier"), F.lit(None).cast("double").alias("confidence")).alias("news"))


@query("upsert_news_block", "classified one proposals", """SELECT folder, part, id, news_type, classifier, confidence, x.changed, 0 AS changed_again FROM (SELECT c.id, coalesce(p.topic, c.news_type) AS news_type, CASE WHEN p.id IS NULL THEN 'keyword' ELSE 'model' END AS classifier, p.confidence, count(p.id) OVER () AS changed
  FROM classified c JOIN one USING (id) LEFT JOIN (SELECT * FROM proposals WHERE pos = 1 AND topic <> 'other') p ON p.id = c.id) x CROSS JOIN (VALUES ('demo'), ('public')) AS f(folder) CROSS JOIN (VALUES ('cards'), ('index')) AS g(part)""")
def _(t):
    from tidemark.sources import cards as cd
    from tidemark.sources.files import scratch

    cards = cards_of(t)
    folders = {name: f"{scratch(cards)}/{name}" for name in ("demo", "public")}
    for path in folders.values():
        cd.write_bucketed(cards, f"{path}/cards")
        cd.write_bucketed(cards.select("id", "cod", "news.*"), f"{path}/index")
    updates = t.proposals.where("pos = 1 and topic <> 'other'").select("id", F.struct(F.col("topic").alias("news_type"), F.lit("model").alias("classifier"), F.col("confidence").cast("double").alias("confidence")).alias("news"))
    run = lambda: cd.upsert_blocks(t.spark, list(folders.values()), updates, index_fields=["news_type", "classifier", "confidence"])
    first, again = run(), run()
    out = None
    for name, path in folders.items():
        for part in ("cards", "index"):
            x = cd.read_bucketed(t.spark, f"{path}/{part}")
            x = x.select("id", "news.*") if part == "cards" else x.select("id", "news_type", "classifier", "confidence")
            x = x.withColumns({"folder": F.lit(name), "part": F.lit(part), "changed": F.lit(first[f"{path}/{part}"]).cast("long"), "changed_again": F.lit(again[f"{path}/{part}"])})
            out = x if out is None else out.unionByName(x)
    return out


@query("fetch_bodies", "one bodies", "SELECT id, md5(body) AS body, length(body) AS n FROM one JOIN bodies USING (id)")
def _(t):
    ids = one_of(t).select("id")
    return t.bodies.join(ids, "id", "left_semi").select("id", F.md5("body").alias("body"), F.length("body").cast("long").alias("n"))


@query("csv_tape_roundtrip", "valid", f"SELECT cod, d, {sr6('last')} FROM valid")
def _(t):
    from tidemark.sources.files import roundtrip_csv

    return roundtrip_csv(tp.valid_quotes(t.quotes).select("cod", "d", "last")).select("cod", "d", *r6("last"))


@query("json_card_scan", "names members", """SELECT n.cod || '.json' AS file, n.cod, n.name, m.sector, CASE WHEN s.k % 5 = 4 THEN 'corrupt' ELSE 'good' END AS state FROM (SELECT *, cast(substr(cod, 2) as bigint) AS k FROM names) s JOIN names n USING (cod) JOIN members m USING (cod) WHERE s.k % 5 <> 4
  UNION ALL SELECT cod || '.json', NULL, NULL, NULL, 'corrupt' FROM names WHERE cast(substr(cod, 2) as bigint) % 5 = 4""")
def _(t):
    from tidemark.sources import cards as cd
    from tidemark.sources.files import scratch

    x = t.names.join(t.members, "cod")
    doc = F.concat(F.lit('{\n "cod": "'), F.col("cod"), F.lit('",\n "card": {"name": "'), F.col("name"), F.lit('",\n  "sector": "'), F.col("sector"), F.lit('"}\n'))
    whole = x.select(F.concat("cod", F.lit(".json")).alias("file"), F.concat(doc, F.when(F.substring("cod", 2, 9).cast("long") % 5 == 4, "").otherwise("}\n")).alias("text"))
    path = scratch(x)
    cd.write_documents(whole.unionByName(t.spark.range(1).select(F.lit("index.json").alias("file"), F.lit('{"cards": []}').alias("text"))), path)
    good, bad = cd.scan_documents(t.spark, path, "cod string, card struct<name:string,sector:string>")
    none = F.lit(None).cast("string")
    return good.select("file", "cod", "card.name", "card.sector", F.lit("good").alias("state")).unionByName(bad.select("file", none.alias("cod"), none.alias("name"), none.alias("sector"), F.lit("corrupt").alias("state")))


@query("write_story_bundle", "stories", """SELECT id, cod, status, strftime(pub_local, '%Y-%m-%d') AS day, peak_d, round(peak_z, 6) AS peak_z, status <> 'NO_REACTION' AS has_series FROM stories""")
def _(t):
    from tidemark.sources import cards as cd
    from tidemark.sources.files import scratch

    s = stories_of(t)
    cards = s.select("id", "cod", "status", F.date_format("pub_local", "yyyy-MM-dd").alias("day"), F.struct("peak_d", F.round("peak_z", 6).alias("peak_z")).alias("peak"), (F.col("status") != "NO_REACTION").alias("has_series"))
    path = scratch(s)
    cd.write_bundle(cards, path, index_fields=["cod", "status", "day", "has_series"])
    index = t.spark.read.schema("id string, cod string, status string, day string, has_series boolean, bucket int").json(f"{path}/index")
    found = t.spark.read.schema("id string, peak struct<peak_d:date,peak_z:double>, bucket int").json(f"{path}/cards")
    return index.join(found.select("id", "peak.*"), "id").select("id", "cod", "status", "day", "peak_d", "peak_z", "has_series")


@query("document_ingest", "", "SELECT conv_id, turn, length(text) AS n FROM conversations")
def _(t):
    from tidemark.sources.files import parse_document

    c = t.base("conversations")
    raw = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("content")))).otherwise(F.col("text"))
    return parse_document(c.withColumn("raw", raw), "raw").select("conv_id", "turn", F.length("body").cast("long").alias("n"))
