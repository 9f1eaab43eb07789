"""Queries over what models say of companies' results: verification, attempts, roll-ups over quarters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.fixtures import Tables, cte
from tidemark.operators import theses as op
from tidemark.plans.study import matched
from tidemark.plans.text import NORM, WORD_LIST, WORDS, nums
from tidemark.registry import query

# ---------------------------------------------------------------- the twin's tables, rule by rule
VALID_STATE = "state IN ('for', 'neutral', 'against')"
cte("press_says", f"SELECT DISTINCT cod, quarter, v FROM (SELECT cod, quarter, unnest({nums('t')}) AS v FROM (SELECT cod, quarter, title || chr(10) || body AS t FROM press))")
cte("press_words", f"SELECT DISTINCT cod, quarter, w FROM press, unnest([{WORD_LIST}]) AS u(w) WHERE contains(lower(title || chr(10) || body), w)")
cte("thesis_names", "SELECT ticker AS cod, indicators[k + 1] AS name, k FROM theses, unnest(range(0, len(indicators))) AS u(k)")
#: One row for each claim that is judged: indicators once for each thesis name and output, the last of their name.
cte("asked", f"""SELECT cod, quarter, no, attempt, kind, row_number() OVER (PARTITION BY cod, quarter, attempt, kind ORDER BY pos) - 1 AS pos, name, state, trim(text) AS text, trim(quote) AS quote, article_id, trim(value) AS value, trim(comparison) AS comparison, CASE WHEN base IN ('y/y', 'q/q') THEN base END AS base,
    CASE kind WHEN 'fact' THEN trim(text) WHEN 'metric' THEN concat_ws(' ', name, trim(value), trim(comparison)) END AS said FROM claims WHERE kind IN ('fact', 'metric')
  UNION ALL SELECT cod, quarter, no, attempt, kind, 0, NULL, CASE WHEN kind = 'impact' THEN CASE WHEN state IN ('stronger', 'unchanged', 'weaker') THEN state ELSE 'unchanged' END END, CASE WHEN kind = 'guidance' AND trim(text) IN ('', 'null', 'None') THEN NULL ELSE trim(text) END, NULL, NULL, NULL, NULL, NULL,
    CASE WHEN kind = 'guidance' AND trim(text) IN ('', 'null', 'None') THEN NULL ELSE trim(text) END FROM claims WHERE kind IN ('guidance', 'changed', 'impact')
  UNION ALL SELECT g.cod, g.quarter, g.no, g.attempt, 'indicator', n.k, n.name, CASE WHEN {VALID_STATE} THEN state ELSE 'not_cited' END, coalesce(nullif(trim(text), ''), 'Not cited in this quarter''s articles.'),
    CASE WHEN {VALID_STATE} THEN nullif(trim(quote), '') END, CASE WHEN {VALID_STATE} THEN article_id END, NULL, NULL, NULL, CASE WHEN {VALID_STATE} THEN coalesce(nullif(trim(text), ''), 'Not cited in this quarter''s articles.') END
    FROM (SELECT DISTINCT cod, quarter, no, attempt FROM claims) g JOIN thesis_names n USING (cod)
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cod, quarter, attempt, name ORDER BY pos DESC) AS k FROM claims WHERE kind = 'indicator') i ON i.k = 1 AND i.cod = g.cod AND i.quarter = g.quarter AND i.attempt = g.attempt AND i.name = n.name""")
ITEM = "cod, quarter, attempt, kind, pos"
cte("wrong_numbers", f"SELECT DISTINCT {ITEM} FROM (SELECT {ITEM}, unnest({nums('said')}) AS v FROM asked) a WHERE NOT EXISTS (SELECT 1 FROM press_says s WHERE s.cod = a.cod AND s.quarter = a.quarter AND s.v = a.v)")
cte("wrong_words", f"SELECT DISTINCT {ITEM} FROM asked a, unnest([{WORD_LIST}]) AS u(w) WHERE regexp_matches(lower(said), '\\b' || w || '\\b') AND NOT EXISTS (SELECT 1 FROM press_words s WHERE s.cod = a.cod AND s.quarter = a.quarter AND s.w = u.w)")
cte("judged", f"""SELECT *, len(reasons) = 0 AS ok FROM (SELECT a.*, list_filter([CASE WHEN quoted AND p.article_id IS NULL THEN 'unknown article' END, CASE WHEN quoted AND p.article_id IS NOT NULL AND NOT coalesce({NORM.format('quote')} <> '' AND contains({NORM.format('body')}, {NORM.format('quote')}), false) THEN 'quote not verbatim' END,
    CASE WHEN bad_n THEN 'numbers' END, CASE WHEN bad_w AND NOT (bad_n AND kind NOT IN ('fact', 'indicator')) THEN 'words' END, CASE WHEN kind = 'metric' AND value <> '' AND NOT regexp_matches(value, '[0-9]') AND NOT bad_n AND NOT bad_w AND NOT EXISTS (
      SELECT 1 FROM press s WHERE s.cod = a.cod AND s.quarter = a.quarter AND contains({NORM.format("(s.title || chr(10) || s.body)")}, {NORM.format('a.value')})) THEN 'value not said' END], lambda r: r IS NOT NULL) AS reasons
  FROM (SELECT a.*, a.kind = 'fact' OR (a.kind = 'indicator' AND a.state <> 'not_cited') AS quoted, n.kind IS NOT NULL AS bad_n, w.kind IS NOT NULL AS bad_w FROM asked a LEFT JOIN wrong_numbers n USING ({ITEM}) LEFT JOIN wrong_words w USING ({ITEM})) a
  LEFT JOIN press p ON p.cod = a.cod AND p.quarter = a.quarter AND p.article_id = a.article_id)""")
cte("reached", """SELECT * FROM (SELECT *, coalesce(count(*) FILTER (ok) OVER (PARTITION BY cod, quarter, attempt, kind ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed FROM judged)
  WHERE passed < CASE kind WHEN 'fact' THEN 3 WHEN 'metric' THEN 4 ELSE 1000000 END""")
SAID = "CASE WHEN kind IN ('fact', 'metric') THEN kind || '[' || pos || ']' WHEN kind = 'indicator' THEN kind || ' ' || name ELSE kind END || ': ' || array_to_string(reasons, ', ')"
cte("attempts", f"""SELECT r.*, c.says AND n_facts > 0 AS relevant, list_concat(said, list_filter([CASE WHEN NOT c.says THEN 'not relevant' END, CASE WHEN n_facts = 0 THEN 'no fact left' END], lambda x: x IS NOT NULL)) AS failures FROM (
  SELECT cod, quarter, no, attempt, count(*) FILTER (kind = 'fact' AND ok) AS n_facts, count(*) FILTER (kind = 'fact' AND NOT ok) AS dropped_facts, count(*) FILTER (kind = 'metric' AND NOT ok) AS dropped_metrics, count(*) FILTER (kind = 'indicator' AND NOT ok) AS dropped_indicators,
    count(*) FILTER (kind IN ('guidance', 'changed', 'impact') AND NOT ok) AS dropped_fields, coalesce(list({SAID} ORDER BY list_position(['fact', 'metric', 'guidance', 'changed', 'impact', 'indicator'], kind), pos) FILTER (NOT ok), []) AS said
  FROM reached GROUP BY cod, quarter, no, attempt) r JOIN (SELECT cod, quarter, attempt, bool_or(text = 'yes') AS says FROM claims WHERE kind = 'relevant' GROUP BY ALL) c USING (cod, quarter, attempt)""")
cte("chosen", """SELECT cod, quarter, attempt FROM (SELECT a.cod, a.quarter, CASE WHEN len(a.failures) > 0 AND (a.dropped_facts + a.dropped_metrics + a.dropped_indicators + a.dropped_fields > 0 OR NOT a.relevant) AND b.n_facts >= a.n_facts THEN 2 ELSE 1 END AS attempt
  FROM attempts a JOIN attempts b ON b.cod = a.cod AND b.quarter = a.quarter AND b.attempt = 2 WHERE a.attempt = 1)""")
cte("taken", "SELECT a.* FROM attempts a JOIN chosen USING (cod, quarter, attempt)")
cte("best_claims", "SELECT r.* FROM reached r JOIN taken b USING (cod, quarter, attempt) WHERE b.relevant")


# ---------------------------------------------------------------- the same in Spark
def outputs_of(t: Tables):
    """One nested output for each company, quarter and attempt, as a model would return it, with the names that its thesis asks for."""
    c, kind = t.claims, F.col("kind")

    def listed(k: str, *fields: str):
        return F.transform(F.sort_array(F.collect_list(F.when(kind == k, F.struct("pos", F.struct(*fields).alias("x"))))), lambda r: r["x"])

    text = lambda k: F.max(F.when(kind == k, F.col("text")))
    c = c.withColumn("note", F.lit(None).cast("string"))
    out = c.groupBy("cod", "quarter", "no", "attempt").agg(
        F.bool_or((kind == "relevant") & (F.col("text") == "yes")).alias("relevant"), listed("fact", "text", "quote", "article_id").alias("facts"), listed("metric", "name", "value", "comparison", "base", "note").alias("metrics"),
        text("guidance").alias("guidance"), text("changed").alias("changed"), F.max(F.when(kind == "impact", F.struct(F.col("state").alias("effect"), "text"))).alias("impact"), listed("indicator", "name", "state", "text", "quote", "article_id").alias("indicators"))
    return out.join(t.theses.select(F.col("ticker").alias("cod"), F.col("indicators").alias("thesis")), "cod")


def attempts_of(t: Tables):
    return op.verify_quarters(outputs_of(t), t.press, keys=["cod", "quarter", "no", "attempt"], group=["cod", "quarter"], vocabulary=WORDS)


def best_of(t: Tables):
    return op.best_attempt(attempts_of(t), keys=["cod", "quarter", "no"])


def joined(c: str, part, sep: str = ","):
    return F.array_join(F.transform(c, part), sep)


@query("fact_verification", "attempts reached", """SELECT a.cod, a.quarter, a.attempt, relevant, array_to_string(failures, '; ') AS failures, dropped_facts, dropped_metrics, dropped_indicators, dropped_fields, coalesce(facts, '') AS facts, coalesce(metrics, '') AS metrics, indicators, guidance, changed, impact FROM attempts a JOIN (
  SELECT cod, quarter, attempt, string_agg(article_id || ':' || text, '|' ORDER BY pos) FILTER (kind = 'fact' AND ok) AS facts, string_agg(concat_ws('=', name, value, comparison, base), '|' ORDER BY pos) FILTER (kind = 'metric' AND ok) AS metrics,
    string_agg(concat_ws('=', name, CASE WHEN ok THEN state ELSE 'not_cited' END, CASE WHEN ok THEN quote END), '|' ORDER BY pos) FILTER (kind = 'indicator') AS indicators, max(text) FILTER (kind = 'guidance' AND ok) AS guidance,
    max(CASE WHEN ok THEN text ELSE 'The comparison with the quarter before cannot be verified.' END) FILTER (kind = 'changed') AS changed, max(state || '=' || CASE WHEN ok THEN text ELSE 'The effect on the thesis cannot be verified.' END) FILTER (kind = 'impact') AS impact
  FROM reached GROUP BY cod, quarter, attempt) r USING (cod, quarter, attempt)""")
def _(t):
    return attempts_of(t).select(
        "cod", "quarter", "attempt", "relevant", F.array_join("failures", "; ").alias("failures"), "dropped_facts", "dropped_metrics", "dropped_indicators", F.size("dropped_fields").cast("long").alias("dropped_fields"),
        joined("facts", lambda f: F.concat(f["article_id"].cast("string"), F.lit(":"), f["text"]), "|").alias("facts"), joined("metrics", lambda m: F.concat_ws("=", m["name"], m["value"], m["comparison"], m["base"]), "|").alias("metrics"),
        joined("indicators", lambda i: F.concat_ws("=", i["name"], i["state"], i["quote"]), "|").alias("indicators"), "guidance", "changed", F.concat("impact.effect", F.lit("="), "impact.text").alias("impact"))


@query("best_attempt", "taken", "SELECT cod, quarter, attempt, relevant, CASE WHEN relevant THEN n_facts ELSE 0 END AS n_facts FROM taken")
def _(t):
    return best_of(t).select("cod", "quarter", "attempt", "relevant", F.size("facts").cast("long").alias("n_facts"))


@query("indicator_latest_cited", "best_claims thesis_names", """SELECT n.cod, n.name AS indicator, coalesce(c.state, 'not_cited') AS state, CASE WHEN c.no < l.no THEN rtrim(c.text, '.') || ' (noted in ' || c.quarter || ').' ELSE c.text END AS text, c.quote, c.article_id, c.quarter, coalesce(c.no < l.no, false) AS older FROM thesis_names n
  LEFT JOIN (SELECT cod, max(no) AS no FROM best_claims GROUP BY cod) l USING (cod)
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cod, name ORDER BY no DESC) AS k FROM best_claims WHERE kind = 'indicator' AND ok AND state <> 'not_cited' AND quote IS NOT NULL) c ON c.k = 1 AND c.cod = n.cod AND c.name = n.name""")
def _(t):
    return op.latest_cited(best_of(t), t.theses)


@query("coverage_sufficiency", "taken recent theses", """SELECT cod, n, array_to_string(missing, ',') AS missing, CASE WHEN n < 2 OR NOT late THEN 'insufficient' ELSE 'ok' END AS coverage FROM (SELECT x.cod, count(b.cod) AS n, coalesce(list(x.quarter ORDER BY x.quarter) FILTER (b.cod IS NULL), []) AS missing, bool_or(b.cod IS NOT NULL AND x.k >= 2) AS late
  FROM (SELECT ticker AS cod, r.* FROM theses CROSS JOIN recent r) x LEFT JOIN (SELECT * FROM taken WHERE relevant) b ON b.cod = x.cod AND b.no = x.no GROUP BY x.cod)""")
def _(t):
    return op.coverage(best_of(t), t.recent, t.theses.select(F.col("ticker").alias("cod"))).select("cod", "n", F.array_join("missing", ",").alias("missing"), "coverage")


@query("quarter_entry_join", "best_claims press recent theses", """SELECT x.cod, x.quarter, f.cod IS NULL AS missing, f.facts, f.sources, f.first_date FROM (SELECT ticker AS cod, r.no, r.quarter FROM theses CROSS JOIN recent r) x LEFT JOIN (
  SELECT c.cod, c.no, string_agg(c.text || '@' || p.url || '@' || p.pub_date, '|' ORDER BY c.pos) AS facts, (SELECT string_agg(url, ',' ORDER BY pub_date, article_id) FROM press s WHERE s.article_id IN (SELECT article_id FROM best_claims d WHERE d.cod = c.cod AND d.no = c.no AND d.kind = 'fact' AND d.ok)) AS sources, min(p.pub_date) AS first_date
  FROM best_claims c JOIN press p ON p.article_id = c.article_id WHERE c.kind = 'fact' AND c.ok GROUP BY c.cod, c.no) f ON f.cod = x.cod AND f.no = x.no""")
def _(t):
    x = op.quarter_entries(best_of(t), t.press, t.recent, t.theses.select(F.col("ticker").alias("cod")))
    source = lambda f: F.concat_ws("@", f["text"], f["source"]["url"], f["source"]["date"].cast("string"))
    return x.select("cod", "quarter", "missing", joined("facts", source, "|").alias("facts"), joined("sources", lambda s: s["url"]).alias("sources"), "first_date")


#: Metric keys in order with the patterns that name them and those that speak against.
METRICS = [
    ("revenue", "^(ricavi|fatturato|revenue|proventi operativi)", ""), ("ebitda", "ebitda", "margin|debito|leva|/|volte"), ("margin", "margin", ""),
    ("net_income", "utile netto|net income|risultato netto", ""), ("eps", "^eps|utile per azione", ""), ("free_cash_flow", "free cash flow|^fcf|flusso di cassa", ""),
]
KEY_SQL = "CASE " + " ".join(f"WHEN regexp_matches({NORM.format('name')}, '{p}')" + (f" AND NOT regexp_matches({NORM.format('name')}, '{x}')" if x else "") + f" THEN '{k}'" for k, p, x in METRICS) + " END"
cte("metric_cells", f"""SELECT cod, no, metric, arg_min(concat_ws(' ', value, nullif(comparison, ''), CASE WHEN comparison <> '' THEN base END), pos) AS value FROM (SELECT *, {KEY_SQL} AS metric FROM best_claims WHERE kind = 'metric' AND ok AND value IS NOT NULL) WHERE metric IS NOT NULL GROUP BY cod, no, metric""")


@query("quarter_metric_pivot", "metric_cells taken recent", "SELECT m.cod, m.metric, " + ", ".join(f"CASE WHEN bool_or(r.k = {i}) THEN coalesce(max(m.value) FILTER (m.no = r.no AND r.k = {i}), 'n/a') END AS q{i}" for i in range(4)) + " FROM metric_cells m JOIN taken b ON b.cod = m.cod AND b.relevant JOIN recent r ON r.no = b.no GROUP BY m.cod, m.metric")
def _(t):
    return op.metric_table(best_of(t), t.recent, METRICS)


@query("metric_key", "claims", f"SELECT key, count(*) AS n FROM (SELECT {KEY_SQL} AS key FROM claims WHERE kind = 'metric') GROUP BY key")
def _(t):
    return t.claims.where("kind = 'metric'").select(op.metric_key("name", METRICS).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


FIELDS = ["summary", "view_1", "view_2", "view_3", "evolution"]
cte("overall_said", " UNION ALL ".join(f"SELECT cod, '{f}' AS field, {f} AS said FROM overall" for f in FIELDS))
cte("field_numbers", f"SELECT DISTINCT cod, field FROM (SELECT cod, field, unnest({nums('said')}) AS v FROM overall_said) o WHERE NOT EXISTS (SELECT 1 FROM press_says s WHERE s.cod = o.cod AND s.v = o.v)")
cte("field_words", f"SELECT DISTINCT cod, field FROM overall_said o, unnest([{WORD_LIST}]) AS u(w) WHERE regexp_matches(lower(said), '\\b' || w || '\\b') AND NOT EXISTS (SELECT 1 FROM press_words s WHERE s.cod = o.cod AND s.w = u.w)")
cte("field_failures", "SELECT cod, field, concat_ws(', ', CASE WHEN n THEN 'numbers' END, CASE WHEN w THEN 'words' END) AS why FROM (SELECT *, true AS n FROM field_numbers) FULL JOIN (SELECT *, true AS w FROM field_words) USING (cod, field)")


def texts_failed(*labels: tuple[str, str]) -> str:
    """The failures of labelled fields by company, as a DuckDB table (cod, texts)."""
    return "(SELECT cod, string_agg(label || ': ' || why, '; ' ORDER BY place) AS texts FROM field_failures JOIN (VALUES " + ", ".join(f"({i}, '{label}', '{f}')" for i, (label, f) in enumerate(labels)) + ") AS l(place, label, field) USING (field) GROUP BY cod)"


def overall_of(t: Tables):
    o = t.overall.withColumn("views", F.array("view_1", "view_2", "view_3"))
    held = t.positions.select(F.col("ticker").alias("cod"), F.lit("portfolio").alias("context"))
    return o.join(held, "cod", "left").withColumn("context", F.coalesce("context", F.lit("watchlist"))).withColumns({"reason": F.col("summary"), "pros": F.col("views"), "risk": F.col("view_2"), "change": F.col("evolution")})


UNWEIGHTED = "coalesce(nullif(trim(regexp_replace({0}, '(?i)\\bweight\\b[^.]*\\.?', '', 'g')), ''), {0})"


@query("aggregate_verification", "overall field_failures", f"""SELECT cod, CASE WHEN state IN ('strengthened', 'unchanged', 'weakened', 'insufficient') THEN state WHEN state IS NULL THEN 'insufficient' ELSE 'unchanged' END AS state, summary, {UNWEIGHTED.format('view_1')} || '|' || {UNWEIGHTED.format('view_2')} AS views, evolution,
  coalesce(texts, '') AS failures FROM overall LEFT JOIN {texts_failed(('summary', 'summary'), ('views[0]', 'view_1'), ('views[1]', 'view_2'), ('evolution', 'evolution'))} USING (cod)""")
def _(t):
    x = op.verify_aggregate(overall_of(t), t.press, vocabulary=WORDS, states=["strengthened", "unchanged", "weakened", "insufficient"])
    return x.select("cod", "state", "summary", F.array_join("views", "|").alias("views"), "evolution", F.array_join("failures", "; ").alias("failures"))


#: What each context allows, the first if a proposal does not fit.
ALLOWED = [("portfolio", 1, "add"), ("portfolio", 2, "hold"), ("portfolio", 3, "reduce"), ("watchlist", 1, "open"), ("watchlist", 2, "watch"), ("watchlist", 3, "drop")]
OK_SQL = "CASE context WHEN 'portfolio' THEN ['add', 'hold', 'reduce'] ELSE ['open', 'watch', 'drop'] END"


def allowed_of(t: Tables):
    return t.spark.createDataFrame(ALLOWED, "context string, place int, action string")


@query("decision_verification", "overall positions field_failures matched", f"""SELECT o.cod, context, CASE WHEN fits THEN action ELSE okay[1] END AS action, concat_ws('; ', CASE WHEN NOT fits THEN 'action not allowed' END, texts) AS failures, coalesce(n.n, 0) AS n_news, n.since AS news_from FROM (
  SELECT *, {OK_SQL} AS okay, list_contains({OK_SQL}, action) AS fits FROM (SELECT *, CASE WHEN cod IN (SELECT ticker FROM positions) THEN 'portfolio' ELSE 'watchlist' END AS context FROM overall)
    LEFT JOIN {texts_failed(('reason', 'summary'), ('pros[0]', 'view_1'), ('pros[1]', 'view_2'), ('pros[2]', 'view_3'), ('risk', 'view_2'), ('change', 'evolution'))} USING (cod)) o LEFT JOIN (SELECT cod, count(*) AS n, min(pub_date) AS since FROM matched GROUP BY cod) n USING (cod)""")
def _(t):
    news = matched(t).groupBy("cod").agg(F.count(F.lit(1)).alias("n"), F.min("pub_date").alias("since"))
    x = op.verify_decision(overall_of(t), t.press, allowed_of(t), news, vocabulary=WORDS)
    return x.withColumn("failures", F.array_join("failures", "; "))


@query("holding_context", "names positions", f"SELECT cod, context, array_to_string({OK_SQL}, ',') AS allowed FROM (SELECT cod, CASE WHEN cod IN (SELECT ticker FROM positions) THEN 'portfolio' ELSE 'watchlist' END AS context FROM names)")
def _(t):
    h = t.positions.select(F.col("ticker").alias("cod"), F.lit("portfolio").alias("context"))
    a = allowed_of(t).groupBy("context").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "action"))), lambda r: r["action"]), ",").alias("allowed"))
    return t.names.join(h, "cod", "left").select("cod", F.coalesce("context", F.lit("watchlist")).alias("context")).join(F.broadcast(a), "context")


@query("grounding_sources", "press", "SELECT cod, quarter, count(*) AS n, md5(string_agg(title || chr(10) || body, chr(10) ORDER BY pub_date, article_id)) AS sources FROM press GROUP BY cod, quarter")
def _(t):
    x = t.press.groupBy("cod", "quarter").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("pub_date", "article_id", F.concat_ws("\n", "title", "body").alias("x")))).alias("x"))
    return x.select("cod", "quarter", "n", F.md5(F.array_join(F.transform("x", lambda r: r["x"]), "\n")).alias("sources"))


@query("longest_bodies_top2", "press", "SELECT cod, quarter, article_id, place FROM (SELECT *, row_number() OVER (PARTITION BY cod, quarter ORDER BY length(body) DESC, pub_date, article_id) AS place FROM press) WHERE place <= 2")
def _(t):
    from tidemark.operators.evidence import top

    return top(t.press, 2, ["cod", "quarter"], F.desc(F.length("body")), "pub_date", "article_id").select("cod", "quarter", "article_id", "place")
