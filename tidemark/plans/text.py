"""Queries over classification and grounding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.fixtures import Tables, cte
from tidemark.operators import text as op
from tidemark.operators.tape import match_names, one_company, publication
from tidemark.plans.tape import names_of
from tidemark.registry import query

WORDS = ["idiot", "moron", "clown", "password", "license"]
CHART = "closed in (?:low|high)|the trend stays"
NORM = r"""trim(regexp_replace(translate(lower({0}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ‘’“”', 'aaaaaaceeeeiiiinooooouuuuyy''''""'), '\s+', ' ', 'g'))"""
BY_TYPE = """SELECT *, coalesce(max(CASE WHEN type = 'capital' THEN CASE WHEN any_hard THEN 1 ELSE 0 END END) OVER (PARTITION BY id), 0) AS cap FROM (
  SELECT id, type, bool_and(soft) AS all_soft, bool_or(hard) AS any_hard FROM {0} GROUP BY id, type)"""
KEPT = f"SELECT * FROM ({BY_TYPE}) WHERE NOT (type = 'earnings' AND all_soft AND cap = 1)"
cte("hits", f"SELECT a.id, r.type, r.rule_no, r.soft, r.hard FROM published a JOIN rules r ON regexp_matches({NORM.format('a.title')}, r.pattern)")
cte("kept_types", KEPT.format("hits"))
cte("classified", """SELECT a.id, coalesce(k.type, 'other') AS news_type, coalesce(h.rules, '') AS rules FROM published a LEFT JOIN (SELECT id, arg_min(type, priority) AS type FROM kept_types JOIN priority USING (type) GROUP BY id) k USING (id)
  LEFT JOIN (SELECT id, string_agg(DISTINCT cast(rule_no as varchar), ',' ORDER BY cast(rule_no as varchar)) AS rules FROM hits GROUP BY id) h USING (id)""")
cte("open_bodies", f"SELECT b.id, substr({NORM.format('b.body')}, 1, 600) AS body FROM bodies b JOIN classified c USING (id) WHERE c.news_type IN ('other', 'market_report')")
cte("body_hits", "SELECT b.id, r.type, r.soft, r.hard FROM open_bodies b JOIN rules r ON regexp_matches(b.body, r.pattern) WHERE r.type <> 'market_report'")
cte("body_kept", KEPT.format("body_hits"))
cte("final_types", "SELECT c.id, coalesce(b.type, c.news_type) AS news_type FROM classified c LEFT JOIN (SELECT id, arg_min(type, priority) AS type FROM body_kept JOIN priority USING (type) GROUP BY id) b USING (id)")
cte("quoted", f"SELECT DISTINCT p.id, p.pos, p.topic FROM proposals p LEFT JOIN rules r ON r.type = p.topic AND regexp_matches({NORM.format('p.evidence')}, r.pattern) WHERE p.topic <> 'other' AND (r.type IS NOT NULL OR (p.topic = 'market_report' AND regexp_matches({NORM.format('p.evidence')}, '{CHART}')))")
WINDOWS = "SELECT {0}, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) AS run FROM (SELECT {0}, string_split({1}, ' ') AS w FROM {2}) WHERE len(w) >= 5"
cte("quote_runs", WINDOWS.format("item_id", NORM.format("text"), "benchmark"))
cte("body_runs", WINDOWS.format("doc_id", NORM.format("text"), "documents"))
cte("met", "SELECT DISTINCT item_id, doc_id FROM quote_runs JOIN body_runs USING (run)")
cte("pairs", "SELECT m.item_id, m.doc_id, b.text AS quote, d.text AS body FROM met m JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)")
cte("turns", """SELECT a.conv_id, a.turn, a.text AS sentence, u.text AS source FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' WHERE a.role = 'assistant'""")


def nums(text: str) -> str:
    """DuckDB list of the numbers of a text; without look-behind, a sign after a digit is cut off beforehand, twice as cuts may touch."""
    plain = f"regexp_replace(regexp_replace(coalesce({text}, ''), '{op.ISO_DATE}', ' ', 'g'), '{op.LONG_DATE}', ' ', 'g')"
    for _ in range(2):
        plain = f"regexp_replace({plain}, '([0-9])[+\\-−–]([0-9])', '\\1 \\2', 'g')"
    y = "ltrim(translate(x, '−–', '--'), '+')"
    marks = f"CASE WHEN contains({y}, ',') AND contains({y}, '.') THEN CASE WHEN strpos(reverse({y}), ',') < strpos(reverse({y}), '.') THEN replace(replace({y}, '.', ''), ',', '.') ELSE replace({y}, ',', '') END ELSE replace({y}, ',', '.') END"
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({plain}, '[+\\-−–]?[0-9]+(?:[.,][0-9]+)*'), lambda x: round(try_cast({marks} as double), 6)), lambda v: v IS NOT NULL))"


def missing(sentence: str, source: str) -> str:
    return f"list_filter({nums(sentence)}, lambda n: NOT list_contains({nums(source)}, n))"


def classified(t: Tables):
    return op.classify(publication(t.articles), t.rules, t.priority)


def turns_of(t: Tables):
    c = t.base("conversations")
    user = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    return c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("sentence")).join(user, ["conv_id", "turn"])


def pairs_of(t: Tables):
    """Benchmark passages and the documents that share a run of five words with them."""
    quotes = t.base("benchmark").select("item_id", F.col("text").alias("quote"))
    bodies = t.base("documents").select("doc_id", F.col("text").alias("body"))
    return op.shingle_pairs(quotes, bodies).join(quotes, "item_id").join(bodies, "doc_id")


@query("rule_title_join", "hits", "SELECT id, type, rule_no FROM hits")
def _(t):
    return op.rule_hits(publication(t.articles), t.rules).select("id", "type", F.col("rule_no"))


@query("rule_hits", "hits", "SELECT type, rule_no, count(*) AS n FROM hits GROUP BY ALL")
def _(t):
    return op.rule_hits(publication(t.articles), t.rules).groupBy("type", "rule_no").agg(F.count(F.lit(1)).alias("n"))


@query("news_type_priority", "classified", "SELECT id, news_type FROM classified")
def _(t):
    return classified(t).select("id", "news_type")


@query("matched_rules", "classified", "SELECT id, rules FROM classified")
def _(t):
    return classified(t).select("id", "rules")


@query("soft_hit_demotion", "kept_types", "SELECT id, type FROM kept_types WHERE cap = 1")
def _(t):
    return op.kept_types(op.rule_hits(publication(t.articles), t.rules)).where("hard").select("id", "type")


#: A headline tells of a move by this pattern, unless it speaks of a sale without a price cue and the hit holds the sale's verb.
MOVE, SALE, VERB, CUE = "[0-9]-(?:urgent|high)", "and supplier", "urgent", "#0000000[0-4]"
cte("moving", f"SELECT id, regexp_matches(t, '{MOVE}') AND NOT (regexp_matches(t, '{SALE}') AND NOT regexp_matches(t, '{CUE}') AND regexp_matches(regexp_extract(t, '{MOVE}'), '{VERB}')) AS reports_move FROM (SELECT id, {NORM.format('title')} AS t FROM published)")


def moving(t: Tables):
    return op.reports_move(publication(t.articles).select("id", "title"), moves=(MOVE,), deal=SALE, deal_verb=VERB, cue=CUE).select("id", "reports_move")


@query("headline_reports_move", "moving", "SELECT id, reports_move FROM moving")
def _(t):
    return moving(t)


@query("classifier_distribution", "classified moving", "SELECT news_type, count(*) AS n, count(*) FILTER (reports_move) AS n_moves FROM classified JOIN moving USING (id) GROUP BY news_type")
def _(t):
    return classified(t).join(moving(t), "id").groupBy("news_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("reports_move").alias("n_moves"))


#: Types whose news is due by a calendar, those that never are, and the dates that make news of capital due.
ALWAYS, NEVER, DUE = ["earnings", "guidance"], ["rating", "legal", "deal"], r"ex[- ]?dividend|coupon (?:on|from) [0-9]|payable on [0-9]|and supplier#0+[1-5]"


@query("scheduled_flag", "classified published", f"SELECT c.id, CASE WHEN news_type IN ('earnings', 'guidance') THEN true WHEN news_type = 'capital' THEN regexp_matches({NORM.format('title')}, '{DUE}') WHEN news_type IN ('rating', 'legal', 'deal') THEN false END AS scheduled FROM classified c JOIN published p USING (id)")
def _(t):
    p = publication(t.articles)
    x = op.classify(p, t.rules, t.priority).join(p.select("id", "title"), "id")
    return x.select("id", op.scheduled("news_type", "title", always=ALWAYS, never=NEVER, dated={"capital": DUE}).alias("scheduled"))


@query("body_fallback", "final_types", "SELECT id, news_type AS final_type FROM final_types")
def _(t):
    # documents are normalised once, then go to the articles that share them
    opening = op.openings(t.base("documents"), key="doc_id", text="text")
    bodies = t.body_keys.join(opening, "doc_id").select("id", "body")
    return op.with_body(classified(t), bodies, t.rules, t.priority).select("id", F.col("news_type").alias("final_type"))


@query("normalise_text", "", f"SELECT doc_id, md5({NORM.format('text')}) AS h FROM documents")
def _(t):
    return t.base("documents").select("doc_id", F.md5(op.normalise("text")).alias("h"))


@query("slugify", "names", "SELECT cod, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM names")
def _(t):
    return t.names.select("cod", op.slug("name").alias("slug"))


@query("slug_collisions", "", "SELECT slug, count(*) AS n FROM (SELECT trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part) GROUP BY slug HAVING count(*) > 1")
def _(t):
    return t.base("part").select(op.slug("p_type").alias("slug")).groupBy("slug").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("verbatim_quote_check", "pairs", f"SELECT item_id, doc_id, contains({NORM.format('body')}, {NORM.format('quote')}) AS ok FROM pairs")
def _(t):
    return pairs_of(t).select("item_id", "doc_id", op.verbatim("body", "quote").alias("ok"))


@query("evidence_supports", "quoted proposals", "SELECT p.id, p.pos, q.id IS NOT NULL AS supports FROM proposals p LEFT JOIN quoted q ON q.id = p.id AND q.pos = p.pos")
def _(t):
    return op.supported(t.proposals, t.rules, label="topic", text="evidence", chart=CHART).select("id", "pos", "supports")


@query("recommendation_grounding", "turns", "SELECT conv_id, turn, count(*) AS missing FROM (SELECT t.conv_id, t.turn, w FROM turns t, unnest(['idiot', 'moron', 'clown', 'password', 'license']) AS v(w) WHERE regexp_matches(lower(sentence), '\\b' || w || '\\b') AND NOT contains(lower(source), w)) GROUP BY ALL")
def _(t):
    x = turns_of(t).withColumn("m", F.size(op.ungrounded_words("sentence", "source", WORDS)))
    return x.where("m > 0").select("conv_id", "turn", F.col("m").cast("long").alias("missing"))


def summed(c: str):
    return [F.size(c).cast("long").alias("n"), F.array_min(c).alias("least"), F.array_max(c).alias("most")]


SUMMED = "len(x) AS n, list_min(x) AS least, list_max(x) AS most"


@query("extract_numbers", "", f"SELECT doc_id, {SUMMED} FROM (SELECT doc_id, {nums('text')} AS x FROM documents)")
def _(t):
    return t.base("documents").select("doc_id", op.numbers("text").alias("x")).select("doc_id", *summed("x"))


@query("number_grounding", "turns", f"SELECT conv_id, turn, {SUMMED} FROM (SELECT conv_id, turn, {missing('sentence', 'source')} AS x FROM turns)")
def _(t):
    return turns_of(t).select("conv_id", "turn", op.ungrounded_numbers("sentence", "source").alias("x")).select("conv_id", "turn", *summed("x"))


@query("ungrounded_numbers", "pairs", f"SELECT item_id, doc_id, {SUMMED} FROM (SELECT item_id, doc_id, {missing('body', 'quote')} AS x FROM pairs)")
def _(t):
    return pairs_of(t).select("item_id", "doc_id", op.ungrounded_numbers("body", "quote").alias("x")).select("item_id", "doc_id", *summed("x"))


WORD_LIST = ", ".join(f"'{w}'" for w in WORDS)
NO_WORDS = f"len(list_filter([{WORD_LIST}], lambda w: regexp_matches(lower(sentence), '\\b' || w || '\\b') AND NOT contains(lower(source), w))) = 0"
FIRST = "trim(regexp_extract(sentence, '^[^.!?]+'))"


FIGURE, ADJECTIVE, HEAD = "regexp_extract(sentence, '[0-9]+')", "regexp_extract(sentence, '[A-Za-z]{5,}')", "split_part(source, chr(10), 1)"
PLAIN = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query("model_output_checks", "turns", f"""SELECT *, numbers_ok AND words_ok AND quote_ok AND figure_ok AND adjective_ok AS all_ok FROM (SELECT conv_id, turn, {PLAIN.format(FIRST)} <> '' AND contains({PLAIN.format('source')}, {PLAIN.format(FIRST)}) AS quote_ok, {FIGURE} <> '' AND contains({PLAIN.format('source')}, {FIGURE}) AS figure_ok,
  {ADJECTIVE} <> '' AND contains(lower({HEAD}), lower({ADJECTIVE})) AS adjective_ok, len({missing('sentence', 'source')}) = 0 AS numbers_ok, {NO_WORDS} AS words_ok FROM turns)""")
def _(t):
    # an answer's quote is its first sentence, its figure the first number, its adjective the first long word; the title is the source's first line
    x = turns_of(t).withColumns({"quote": F.trim(F.regexp_extract("sentence", r"^[^.!?]+", 0)), "figure": F.regexp_extract("sentence", "[0-9]+", 0), "adjective": F.regexp_extract("sentence", "[A-Za-z]{5,}", 0), "title": F.split_part("source", F.lit("\n"), F.lit(1))})
    return op.output_checks(x, vocabulary=WORDS).select("conv_id", "turn", *op.CHECKS, "all_ok")


@query("body_reports_move")
def _(t):
    moves = (r"(?:rises|falls|gains|loses) (?:by )?[0-9]+(?:[.,][0-9]+)?\s*%", r"closed? in (?:the )?(?:red|green)")
    return op.reports_move(t.base("documents").select("doc_id", "text"), text="text", moves=moves).select("doc_id", "reports_move")


def stories(t: Tables):
    """Articles whose body names their companies twice, or no one, or another company that the title does not name."""
    n = t.base("supplier").agg(F.count(F.lit(1)).alias("n"))  # one row
    k = F.col("id").cast("long")
    body = F.when(k % 3 == 0, F.concat_ws(" and ", "title", "title")).when(k % 3 == 1, "no name here").otherwise(F.concat(F.lit("about Supplier#"), F.lpad((k * 7 % F.col("n")).cast("string"), 9, "0"), F.lit(" today")))
    return publication(t.articles).crossJoin(F.broadcast(n)).withColumn("body", body).select("id", "title", "body")


cte("story_texts", """SELECT id, title, CASE k % 3 WHEN 0 THEN title || ' and ' || title WHEN 1 THEN 'no name here' ELSE 'about Supplier#' || lpad(cast(k * 7 % n as varchar), 9, '0') || ' today' END AS body FROM (SELECT *, cast(id as bigint) AS k FROM published) CROSS JOIN (SELECT count(*) AS n FROM supplier)""")
cte("candidate_hits", """SELECT t.id, n.cod, n.name, bool_or(place = 'title') AS in_title, count(*) FILTER (place = 'body') AS hits FROM (
  SELECT id, 'title' AS place, unnest(regexp_extract_all(title, '[0-9A-Za-z_#]+')) AS token FROM story_texts UNION ALL SELECT id, 'body', unnest(regexp_extract_all(body, '[0-9A-Za-z_#]+')) FROM story_texts) t JOIN universe n ON n.name = t.token GROUP BY t.id, n.cod, n.name""")


@query("instrument_candidates", "candidate_hits", "SELECT id, cod, in_title, hits FROM candidate_hits")
def _(t):
    return op.candidates(stories(t), names_of(t)).select("id", "cod", "in_title", "hits")


@query("candidate_top30", "candidate_hits", "SELECT id, cod, in_title, place FROM (SELECT id, cod, in_title, row_number() OVER (PARTITION BY id ORDER BY in_title DESC, hits DESC, length(name) DESC, cod) AS place FROM candidate_hits) WHERE place <= 30")
def _(t):
    return op.candidates(stories(t), names_of(t)).select("id", "cod", "in_title", F.col("place").cast("long").alias("place"))


@query("examples_per_type", "classified", "SELECT news_type, id FROM (SELECT *, row_number() OVER (PARTITION BY news_type ORDER BY md5(id || ':7'), id) AS k FROM classified) WHERE k <= 12")
def _(t):
    # the seed is part of what is hashed
    w = Window.partitionBy("news_type").orderBy(F.md5(F.concat("id", F.lit(":7"))), "id")
    return classified(t).withColumn("k", F.row_number().over(w)).where("k <= 12").select("news_type", "id")


@query("name_search_with_exclusion", "published", r"SELECT id FROM published WHERE regexp_matches(title, '\bSupplier#0+1\b') AND NOT regexp_matches(title, 'and Supplier')")
def _(t):
    return publication(t.articles).where(F.col("title").rlike(r"(?<![0-9A-Za-z_])Supplier#0+1(?![0-9A-Za-z_])") & ~F.col("title").rlike("and Supplier")).select("id")


@query("tokens_stopwords", "", r"SELECT item_id, count(DISTINCT w) AS n FROM benchmark, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS u(w) WHERE w NOT IN ('the', 'and', 'for') GROUP BY item_id")
def _(t):
    w = F.array_except(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0), F.array(*[F.lit(x) for x in ("the", "and", "for")]))
    return t.base("benchmark").select("item_id", F.size(F.array_distinct(w)).cast("long").alias("n")).where("n > 0")


CONTROLLED = ["capital", "earnings", "guidance", "legal", "rating", "deal", "market_report"]


cte("named", "SELECT m.id, m.cod, n.name FROM matches m JOIN universe n USING (cod)")


@query("classification_validation", "published proposals answers named", f"""SELECT a.id, concat_ws('; ', CASE WHEN NOT EXISTS (SELECT 1 FROM named m WHERE m.id = a.id AND lower(m.cod) = lower(w.ticker) AND {NORM.format('m.name')} = {NORM.format('w.company_name')}) THEN 'company is no candidate' END,
    CASE WHEN {NORM.format('w.company_evidence')} = '' OR NOT contains({NORM.format('a.title')}, {NORM.format('w.company_evidence')}) THEN 'company evidence' END, CASE WHEN p.n IS NULL OR p.n > 3 THEN 'topic count' END, CASE WHEN p.bad_topic THEN 'topic' END, CASE WHEN p.bad_confidence THEN 'confidence' END, CASE WHEN p.bad_quote THEN 'evidence' END,
    CASE WHEN p.n <> p.distinct_n THEN 'topics repeat' END, CASE WHEN coalesce(w.other_topic, p.first_topic, '') NOT IN ({', '.join(f"'{c}'" for c in CONTROLLED)}) THEN 'primary topic' END, CASE WHEN p.n > 0 AND w.other_topic <> p.first_topic THEN 'primary is not first' END, CASE WHEN trim(w.summary) = '' THEN 'summary' END) AS errors
  FROM published a JOIN answers w USING (id) LEFT JOIN (SELECT p.id, count(*) AS n, count(DISTINCT p.topic) AS distinct_n, arg_min(p.topic, p.pos) AS first_topic, bool_or(p.topic NOT IN ({', '.join(f"'{c}'" for c in CONTROLLED)})) AS bad_topic, bool_or(NOT p.confidence BETWEEN 0 AND 1) AS bad_confidence,
    bool_or(NOT contains({NORM.format('a.title')}, {NORM.format('p.evidence')})) AS bad_quote FROM proposals p JOIN published a USING (id) GROUP BY p.id) p USING (id)""")
def _(t):
    p = publication(t.articles).select("id", "title", F.col("title").alias("body"))
    names = names_of(t)
    candidates = match_names(p, names).join(names.select("cod", "name"), "cod")
    first = t.proposals.groupBy("id").agg(F.min_by("topic", "pos").alias("first"))
    answers = t.answers.join(first, "id", "left").withColumn("primary_topic", F.coalesce("other_topic", "first"))
    return op.validated(p, answers, t.proposals, candidates, topics=CONTROLLED).select("id", F.array_join("errors", "; ").alias("errors"))


@query("review_rates", "", "SELECT quality, toxic, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels), 6) AS rate FROM labels GROUP BY ALL")
def _(t):
    x = t.base("labels")
    total = x.agg(F.count(F.lit(1)).alias("all"))
    n = x.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(total)).select("quality", "toxic", "n", F.round(F.col("n") / F.col("all"), 6).alias("rate"))


@query("choose_type", "classified hits quoted published", f"""SELECT c.id, CASE WHEN q.topic IS NOT NULL THEN q.topic WHEN k.own THEN c.news_type ELSE 'other' END AS final_type, CASE WHEN q.topic IS NOT NULL THEN 'model_quote' WHEN k.own THEN 'keyword_title' ELSE 'unsupported' END AS reason
  FROM classified c LEFT JOIN (SELECT id, arg_min(topic, pos) AS topic FROM quoted GROUP BY id) q USING (id)
  LEFT JOIN (SELECT c.id, bool_or(h.type = c.news_type OR (c.news_type = 'market_report' AND regexp_matches({NORM.format('a.title')}, '{CHART}'))) AS own FROM classified c JOIN published a USING (id) LEFT JOIN hits h USING (id) GROUP BY c.id) k USING (id)""")
def _(t):
    p = publication(t.articles)
    titled = op.classify(p, t.rules, t.priority).join(p.select("id", "title"), "id")
    return op.choose_type(titled, t.proposals, t.rules, chart=CHART)
