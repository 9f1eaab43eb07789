"""Queries over sector legs, narrative and the index."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.fixtures import Tables, cte
from tidemark.operators import sentiment as op
from tidemark.operators.tape import valid_quotes
from tidemark.plans.tape import r6, sr6
from tidemark.registry import query

START = "1996-01-01"
DIM = 64

cte("name_days", """SELECT m.sector, s.*, stddev_samp(ret) OVER b AS sd_b, count(ret) OVER b AS n_b, max(high) OVER y AS high_52, min(low) OVER y AS low_52, count(high) OVER y AS n_52
  FROM sessions s JOIN members m USING (cod) WINDOW b AS (PARTITION BY cod ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), y AS (PARTITION BY cod ORDER BY idx ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""")
cte("sector_days", """SELECT sector, d, avg(ret) AS sector_ret, count(*) FILTER (n_b = 20 AND sd_b > 0) AS names, count(*) FILTER (n_b = 20 AND sd_b > 0 AND abs(ret) >= 2 * sd_b) AS shocks,
  count(*) FILTER (n_b = 20 AND sd_b > 0 AND abs(ret) >= 2 * sd_b AND ret < 0) AS shocks_down, count(*) FILTER (n_b = 20 AND sd_b > 0 AND abs(ret) >= 2 * sd_b AND ret > 0) AS shocks_up,
  count(*) FILTER (n_52 >= 252 AND high_52 > 0 AND last >= 0.95 * high_52) AS n_high, count(*) FILTER (n_52 >= 252 AND low_52 > 0 AND last <= 1.05 * low_52) AS n_low,
  count(*) FILTER (n_52 >= 252 AND high_52 > 0 AND low_52 > 0) AS n_strength, sum(CASE WHEN ret > 0 THEN qty ELSE 0 END) AS up_qty, sum(CASE WHEN ret < 0 THEN qty ELSE 0 END) AS down_qty, sum(qty) AS total_qty
  FROM name_days WHERE ret IS NOT NULL GROUP BY sector, d""")
LN = "CASE WHEN 1 + sector_ret > 0 THEN ln(1 + sector_ret) END"
cte("legs", f"""SELECT *, (n_high - n_low) / nullif(n_strength, 0) AS strength_raw, (up_qty - down_qty) / nullif(total_qty, 0) AS breadth_raw, exp(sum({LN}) OVER m) - 1 AS momentum_raw, count({LN}) OVER m AS n_mom,
  stddev_samp(sector_ret) OVER v AS vol_raw, count(sector_ret) OVER v AS n_vol FROM sector_days
  WINDOW m AS (PARTITION BY sector ORDER BY d ROWS BETWEEN 124 PRECEDING AND CURRENT ROW), v AS (PARTITION BY sector ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
cte("gated", "SELECT * FROM legs WHERE n_mom = 125 AND n_vol = 20 AND n_strength > 0 AND strength_raw IS NOT NULL AND breadth_raw IS NOT NULL AND momentum_raw IS NOT NULL AND vol_raw > 0")
# each vector is an article of one of the sessions of its sector: dates are dealt by id
cte("regions", "SELECT r_name AS sector, r_regionkey AS k FROM region")
cte("vectors", """SELECT cast(vec_id as varchar) AS id, date '1997-01-01' + cast(vec_id % 500 as integer) AS d, embedding, label FROM embeddings""")
cte("sector_vec", """SELECT sector, list(v ORDER BY pos) AS embedding FROM (SELECT r.sector, pos, avg(cast(e.embedding[pos] as double)) AS v FROM embeddings e JOIN regions r ON r.k = e.label % 5, unnest(range(1, 65)) AS u(pos)
  WHERE len(e.embedding) = 64 GROUP BY r.sector, pos) GROUP BY sector HAVING count(*) = 64""")
DOT = "list_sum(list_transform(range(1, 65), lambda i: cast({a}[i] as double) * {b}[i]))"


def duck_cos(a: str, b: str) -> str:
    d = lambda x, y: DOT.format(a=x, b=y)
    return f"{d(a, b)} / (sqrt({d(a, a)}) * sqrt({d(b, b)}))"


cte("scores", f"SELECT v.id, v.d, v.embedding, s.sector, {duck_cos('v.embedding', 's.embedding')} AS cosine FROM vectors v CROSS JOIN sector_vec s")
cte("best", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, sector) AS k FROM scores) WHERE k = 1 AND cosine >= 0.1")
cte("tiles", f"SELECT sector, d, ntile(5) OVER (PARTITION BY sector ORDER BY sector_ret, d) AS tile FROM sector_days WHERE d >= date '{START}'")
cte("pole_vec", """SELECT sector, kind, list(v ORDER BY pos) AS embedding FROM (SELECT b.sector, CASE WHEN tile = 1 THEN 'fear' ELSE 'greed' END AS kind, pos, avg(cast(b.embedding[pos] as double)) AS v
  FROM best b JOIN tiles t ON t.sector = b.sector AND t.d = b.d AND tile IN (1, 5), unnest(range(1, 65)) AS u(pos) GROUP BY ALL) GROUP BY sector, kind""")
cte("day_vec", "SELECT sector, d, list(v ORDER BY pos) AS embedding FROM (SELECT b.sector, b.d, pos, avg(cast(b.embedding[pos] as double)) AS v FROM best b, unnest(range(1, 65)) AS u(pos) GROUP BY ALL) GROUP BY sector, d")
cte("narrative", f"""SELECT dv.sector, dv.d, {duck_cos('dv.embedding', 'g.embedding')} - {duck_cos('dv.embedding', 'f.embedding')} AS narrative_raw FROM day_vec dv
  JOIN pole_vec g ON g.sector = dv.sector AND g.kind = 'greed' JOIN pole_vec f ON f.sector = dv.sector AND f.kind = 'fear'""")
cte("narrated", """SELECT g.*, n.narrative_raw, r.narrative_pct FROM gated g LEFT JOIN narrative n USING (sector, d)
  LEFT JOIN (SELECT n.sector, n.d, 100 * cume_dist() OVER (PARTITION BY n.sector ORDER BY round(narrative_raw, 9)) AS narrative_pct FROM narrative n JOIN gated USING (sector, d)) r USING (sector, d)""")
PCT = "100 * cume_dist() OVER (PARTITION BY sector ORDER BY {})"
cte("indexed", f"""SELECT *, momentum * w_momentum + strength * w_strength + breadth * w_breadth + volatility * w_volatility + narrative * w_narrative AS score FROM (
  SELECT *, 0.2 + 0.1 * (narrative - 50) / 50 AS w_momentum, 0.2 + 0.05 * (narrative - 50) / 50 AS w_strength, 0.2 - 0.05 * (narrative - 50) / 50 AS w_breadth, 0.2 - 0.1 * (narrative - 50) / 50 AS w_volatility, cast(0.2 as double) AS w_narrative FROM (
  SELECT *, {PCT.format('momentum_raw')} AS momentum, {PCT.format('strength_raw')} AS strength, {PCT.format('breadth_raw')} AS breadth, 100 - {PCT.format('vol_raw')} AS volatility,
    coalesce(last_value(narrative_pct IGNORE NULLS) OVER (PARTITION BY sector ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 50) AS narrative FROM narrated))""")
LABEL = "CASE WHEN {0} < 25 THEN 'Extreme fear' WHEN {0} < 45 THEN 'Fear' WHEN {0} < 55 THEN 'Neutral' WHEN {0} < 75 THEN 'Greed' ELSE 'Extreme greed' END"
cte("composite", """SELECT d, avg(score) AS score, avg(momentum) AS momentum, avg(strength) AS strength, avg(breadth) AS breadth, avg(volatility) AS volatility, avg(narrative) AS narrative,
  sum(shocks) AS shocks, sum(shocks_down) AS shocks_down, sum(shocks_up) AS shocks_up, sum(names) AS names FROM indexed GROUP BY d HAVING count(*) = (SELECT count(DISTINCT sector) FROM indexed)""")


def days_of(t: Tables):
    return op.sector_days(op.name_days(t.quotes, t.members))


def legs_of(t: Tables):
    return op.sector_legs(days_of(t))


def vectors_of(t: Tables):
    e = t.base("embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), F.date_add(F.lit("1997-01-01").cast("date"), (F.col("vec_id") % 500).cast("int")).alias("d"), "embedding", "label")


def sector_vec_of(t: Tables):
    r = t.base("region").select(F.col("r_name").alias("sector"), F.col("r_regionkey").alias("k"))
    e = t.base("embeddings").withColumn("k", (F.col("label") % 5).cast("long"))
    return op.vector_mean(e.join(F.broadcast(r), "k"), "sector", dim=DIM)  # a row for each sector


def best_of(t: Tables):
    return op.best_sector(vectors_of(t), sector_vec_of(t), least=0.1)


def tiles_of(t: Tables):
    return days_of(t).where(F.col("d") >= START).withColumn("tile", F.ntile(5).over(Window.partitionBy("sector").orderBy("sector_ret", "d"))).select("sector", "d", "tile")


def poles_of(t: Tables):
    src = best_of(t).join(tiles_of(t).where("tile in (1, 5)"), ["sector", "d"])
    return op.vector_mean(src.withColumn("kind", F.when(F.col("tile") == 1, "fear").otherwise("greed")), "sector", "kind", dim=DIM)


def narrative_of(t: Tables):
    poles, days = poles_of(t), op.vector_mean(best_of(t), "sector", "d", dim=DIM)
    pole = lambda k: F.broadcast(poles.where(F.col("kind") == k).select("sector", F.col("embedding").alias(k)))
    both = days.join(pole("greed"), "sector").join(pole("fear"), "sector")  # two rows for each sector
    return both.select("sector", "d", (op.cosine(F.col("embedding"), F.col("greed")) - op.cosine(F.col("embedding"), F.col("fear"))).alias("narrative_raw"))


def narrated_of(t: Tables):
    n = op.gate(legs_of(t)).join(narrative_of(t), ["sector", "d"], "left")
    ranked = n.where("narrative_raw is not null").withColumn("r", F.round("narrative_raw", 9)).select("sector", "d", op.percentile("r").alias("narrative_pct"))
    return n.join(ranked, ["sector", "d"], "left")


def index_of(t: Tables):
    return op.sector_index(narrated_of(t))


@query("high_low_52w", "name_days", f"SELECT cod, d, {sr6('high_52', 'low_52')}, n_52 FROM name_days")
def _(t):
    return op.name_days(t.quotes, t.members).select("cod", "d", *r6("high_52", "low_52"), "n_52")


@query("sector_membership_join", "valid members", "SELECT sector, cod, count(*) AS n FROM valid JOIN members USING (cod) GROUP BY ALL")
def _(t):
    return valid_quotes(t.quotes).join(t.members, "cod").groupBy("sector", "cod").agg(F.count(F.lit(1)).alias("n"))


@query("sector_day", "sector_days", f"SELECT sector, d, {sr6('sector_ret')}, names, shocks, shocks_down, shocks_up, n_high, n_low, n_strength, {sr6('up_qty', 'down_qty', 'total_qty')} FROM sector_days")
def _(t):
    return days_of(t).select("sector", "d", *r6("sector_ret"), "names", "shocks", "shocks_down", "shocks_up", "n_high", "n_low", "n_strength", *r6("up_qty", "down_qty", "total_qty"))


@query("strength_breadth", "legs", f"SELECT sector, d, {sr6('strength_raw', 'breadth_raw')} FROM legs")
def _(t):
    return legs_of(t).select("sector", "d", *r6("strength_raw", "breadth_raw"))


@query("compounded_momentum", "legs", "SELECT sector, d, round(ln(1 + momentum_raw), 6) AS log_momentum, n_mom FROM legs")
def _(t):
    return legs_of(t).select("sector", "d", F.round(F.log1p("momentum_raw"), 6).alias("log_momentum"), "n_mom")


@query("rolling_vol", "legs", f"SELECT sector, d, {sr6('vol_raw')}, n_vol FROM legs")
def _(t):
    return legs_of(t).select("sector", "d", *r6("vol_raw"), "n_vol")


@query("sentiment_gate", "gated", "SELECT sector, count(*) AS n, min(d) AS first_d FROM gated GROUP BY sector")
def _(t):
    return op.gate(legs_of(t)).groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_d"))


@query("return_quintiles", "tiles", "SELECT sector, d, tile FROM tiles")
def _(t):
    return tiles_of(t).withColumn("tile", F.col("tile").cast("long"))


@query("embeddings_by_dim", "", "SELECT vec_id, label FROM embeddings WHERE len(embedding) = 64")
def _(t):
    return t.base("embeddings").where(F.size("embedding") == DIM).select("vec_id", "label")


@query("vector_mean", "", "SELECT label, pos, round(avg(cast(embedding[pos] as double)), 6) AS v FROM embeddings, unnest(range(1, 65)) AS u(pos) WHERE len(embedding) = 64 GROUP BY label, pos")
def _(t):
    m = op.vector_mean(t.base("embeddings"), "label", dim=DIM)
    return m.select("label", F.posexplode("embedding").alias("p", "v")).select("label", (F.col("p") + 1).cast("long").alias("pos"), *r6("v"))


@query("article_sector_cosine", "scores", f"SELECT id, sector, {sr6('cosine')} FROM scores")
def _(t):
    pairs = vectors_of(t).crossJoin(F.broadcast(sector_vec_of(t).withColumnRenamed("embedding", "s")))  # a row for each sector
    return pairs.select("id", "sector", F.round(op.cosine(F.col("embedding"), F.col("s")), 6).alias("cosine"))


@query("best_sector_assignment", "best", f"SELECT id, sector, {sr6('cosine')} FROM best")
def _(t):
    return best_of(t).select("id", "sector", *r6("cosine"))


@query("pole_vectors", "pole_vec", "SELECT sector, kind, pos, round(embedding[pos], 6) AS v FROM pole_vec, unnest(range(1, 65)) AS u(pos)")
def _(t):
    return poles_of(t).select("sector", "kind", F.posexplode("embedding").alias("p", "v")).select("sector", "kind", (F.col("p") + 1).cast("long").alias("pos"), *r6("v"))


@query("narrative_raw", "narrative", f"SELECT sector, d, {sr6('narrative_raw')} FROM narrative")
def _(t):
    return narrative_of(t).select("sector", "d", *r6("narrative_raw"))


@query("top3_headlines", "best", "SELECT sector, d, cast(to_json(list(id ORDER BY cosine DESC, id)) as varchar) AS headlines FROM (SELECT *, row_number() OVER (PARTITION BY sector, d ORDER BY cosine DESC, id) AS p FROM best) WHERE p <= 3 GROUP BY sector, d")
def _(t):
    w = Window.partitionBy("sector", "d").orderBy(F.desc("cosine"), "id")
    top = best_of(t).withColumn("p", F.row_number().over(w)).where("p <= 3")
    return top.groupBy("sector", "d").agg(F.sort_array(F.collect_list(F.struct("p", "id"))).alias("x")).select("sector", "d", F.to_json(F.transform("x", lambda x: x["id"])).alias("headlines"))


@query("sentiment_joined", "narrated", f"SELECT sector, d, round(ln(1 + momentum_raw), 6) AS log_momentum, {sr6('narrative_raw')}, narrative_raw IS NULL AS quiet FROM narrated")
def _(t):
    return narrated_of(t).select("sector", "d", F.round(F.log1p("momentum_raw"), 6).alias("log_momentum"), *r6("narrative_raw"), F.col("narrative_raw").isNull().alias("quiet"))


@query("narrative_percentile", "narrated", f"SELECT sector, d, {sr6('narrative_pct')} FROM narrated WHERE narrative_pct IS NOT NULL")
def _(t):
    return narrated_of(t).where("narrative_pct is not null").select("sector", "d", *r6("narrative_pct"))


@query("component_percentiles", "indexed", f"SELECT sector, d, {sr6('momentum', 'strength', 'breadth', 'volatility')} FROM indexed")
def _(t):
    return index_of(t).select("sector", "d", *r6("momentum", "strength", "breadth", "volatility"))


@query("carry_forward", "indexed", f"SELECT sector, d, {sr6('narrative')} FROM indexed")
def _(t):
    return index_of(t).select("sector", "d", *r6("narrative"))


@query("tilted_weights", "indexed", f"SELECT sector, d, {sr6('w_momentum', 'w_strength', 'w_breadth', 'w_volatility', 'w_narrative', 'score')}, {LABEL.format('score')} AS label FROM indexed")
def _(t):
    return index_of(t).select("sector", "d", *r6("w_momentum", "w_strength", "w_breadth", "w_volatility", "w_narrative", "score"), "label")


@query("trailing_5_sum", "indexed", "SELECT sector, d, sum(shocks) OVER w AS shocks_5d, sum(shocks_down) OVER w AS shocks_down_5d, sum(shocks_up) OVER w AS shocks_up_5d FROM indexed WINDOW w AS (PARTITION BY sector ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _(t):
    return op.trailing(index_of(t), "sector").select("sector", "d", "shocks_5d", "shocks_down_5d", "shocks_up_5d")


@query("spark_63", "indexed", "SELECT sector, string_agg(cast(d as varchar), ',' ORDER BY d) AS days, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY d DESC) AS k FROM indexed) WHERE k <= 63 GROUP BY sector")
def _(t):
    w = Window.partitionBy("sector").orderBy(F.desc("d"))
    last = index_of(t).withColumn("k", F.row_number().over(w)).where("k <= 63")
    return last.groupBy("sector").agg(F.array_join(F.transform(F.sort_array(F.collect_list("d")), lambda x: x.cast("string")), ",").alias("days"), F.count(F.lit(1)).alias("n"))


@query("composite_index", "composite", f"SELECT d, {sr6('score', 'momentum', 'strength', 'breadth', 'volatility', 'narrative')}, shocks, shocks_down, shocks_up, names, {LABEL.format('score')} AS label FROM composite")
def _(t):
    return op.composite(index_of(t)).select("d", *r6("score", "momentum", "strength", "breadth", "volatility", "narrative"), "shocks", "shocks_down", "shocks_up", "names", "label")


@query("shock_counts", "sector_days", "SELECT d, sum(names) AS names, sum(shocks) AS shocks, sum(shocks_up) AS up, sum(shocks_down) AS down, round(CASE WHEN sum(names) = 0 THEN 0 ELSE sum(shocks) / sum(names) END, 6) AS share FROM sector_days GROUP BY d")
def _(t):
    s = days_of(t).groupBy("d").agg(F.sum("names").alias("names"), F.sum("shocks").alias("shocks"), F.sum("shocks_up").alias("up"), F.sum("shocks_down").alias("down"))
    return s.withColumn("share", F.round(F.coalesce(F.try_divide("shocks", "names"), F.lit(0.0)), 6))


cte("listed_now", "SELECT sector, cod, row_number() OVER (PARTITION BY sector ORDER BY cod) AS pos FROM members")
cte("listed_before", "SELECT m.sector, m.cod, row_number() OVER (PARTITION BY m.sector ORDER BY m.cod) AS pos FROM members m JOIN names n USING (cod) WHERE n.kind = 'ORD'")


@query("membership_diff", "listed_now listed_before", """SELECT coalesce(n.sector, b.sector) AS sector, coalesce(n.cod, b.cod) AS cod, CASE WHEN b.cod IS NULL THEN 'added' WHEN n.cod IS NULL THEN 'removed' ELSE 'moved' END AS change
  FROM listed_now n FULL JOIN listed_before b ON n.sector = b.sector AND n.cod = b.cod WHERE b.cod IS NULL OR n.cod IS NULL OR n.pos <> b.pos""")
def _(t):
    listed = lambda rows: rows.withColumn("pos", F.row_number().over(Window.partitionBy("sector").orderBy("cod")))
    return op.membership_diff(listed(t.members), listed(t.members.join(t.names.where("kind = 'ORD'").select("cod"), "cod", "left_semi")))


@query("sector_of_ticker", "names sector_lists", "SELECT n.cod, arg_min(l.sector, l.pos) AS sector FROM names n LEFT JOIN sector_lists l ON l.ticker = n.cod GROUP BY n.cod")
def _(t):
    lists = t.sector_lists.groupBy("pos", "sector").agg(F.collect_list("ticker").alias("tickers"))
    return op.sector_of(t.names.select("cod"), lists)
