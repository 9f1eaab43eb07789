"""Rule-table classification and grounding of sentences in their sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accented letters and the plain ones that stand for them, and curly quotes.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ‘’“”"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy''\"\""


def normalise(c: Column | str) -> Column:
    """Lower case, accents stripped, straight quotes, single spaces."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"\s+", " "))


def slug(c: Column | str) -> Column:
    out = F.regexp_replace(F.regexp_replace(normalise(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "company").otherwise(out)


def rule_hits(texts: DataFrame, rules: DataFrame, *, text: str = "title") -> DataFrame:
    """(id, type, rule_no, soft, hard) for each rule that fires on the normalised text. rules is the caller's table of patterns, some hundreds at most."""
    normal = texts.select("id", normalise(text).alias("_n"))
    return normal.join(F.broadcast(rules), F.expr("_n rlike pattern")).select("id", "type", "rule_no", "soft", "hard")


def kept_types(hits: DataFrame) -> DataFrame:
    """(id, type) without earnings whose hits are all soft where a hard capital rule fires."""
    by_type = hits.groupBy("id", "type").agg(F.bool_and("soft").alias("all_soft"), F.bool_or("hard").alias("any_hard"))
    hard = F.coalesce(F.max(F.when(F.col("type") == "capital", F.col("any_hard"))).over(Window.partitionBy("id")), F.lit(False))
    return by_type.withColumn("hard", hard).where(~((F.col("type") == "earnings") & F.col("all_soft") & F.col("hard"))).select("id", "type", "hard")


def picked(texts: DataFrame, hits: DataFrame, priority: DataFrame) -> DataFrame:
    """(id, news_type, rules): the first kept type by priority and the numbers of all rules that fired; other without any."""
    best = kept_types(hits).join(F.broadcast(priority), "type").groupBy("id").agg(F.min(F.struct("priority", "type")).alias("b"))
    listed = hits.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("rule_no")), lambda x: x.cast("string")), ",").alias("rules"))
    out = texts.select("id").join(best.select("id", F.col("b.type").alias("news_type")), "id", "left").join(listed, "id", "left")
    return out.select("id", F.coalesce("news_type", F.lit("other")).alias("news_type"), F.coalesce("rules", F.lit("")).alias("rules"))


def classify(texts: DataFrame, rules: DataFrame, priority: DataFrame, *, text: str = "title") -> DataFrame:
    """`picked` of the hits on a text."""
    return picked(texts, rule_hits(texts, rules, text=text), priority)


def openings(texts: DataFrame, *, key: str, text: str, reach: int = 600) -> DataFrame:
    """(key, body): the first `reach` normalised characters of each text, for texts that many articles share."""
    return texts.select(key, F.substring(normalise(text), 1, reach).alias("body"))


def with_body(titled: DataFrame, bodies: DataFrame, rules: DataFrame, priority: DataFrame, *, weak: tuple[str, ...] = ("other", "market_report"), reach: int = 600) -> DataFrame:
    """(id, news_type): a weak type gives way to what the first `reach` normalised characters of the body say, tape talk aside."""
    open_ = bodies.join(titled.where(F.col("news_type").isin(*weak)).select("id"), "id", "left_semi").select("id", F.substring(normalise("body"), 1, reach).alias("body"))
    hits = rule_hits(open_, rules, text="body").where("type <> 'market_report'")
    body = picked(open_, hits, priority).select("id", F.col("news_type").alias("_body")).where("_body <> 'other'")
    return titled.join(body, "id", "left").select("id", F.coalesce("_body", "news_type").alias("news_type"))


def supported(rows: DataFrame, rules: DataFrame, *, label: str, text: str, chart: str) -> DataFrame:
    """rows plus supports: whether a rule of the label fires on the text, or it is chart talk under market_report; never for other.

    rules is the caller's table of patterns, some hundreds at most: each type's patterns become one literal, compiled once.
    """
    n = F.col("_n")
    by_type = {r["type"]: "|".join(f"(?:{p})" for p in r["patterns"]) for r in rules.groupBy("type").agg(F.sort_array(F.collect_list("pattern")).alias("patterns")).collect()}
    on = F.lit(False)
    for kind in sorted(by_type.keys() | {"market_report"}):
        fires = [n.rlike(p) for p in ([by_type[kind]] if kind in by_type else []) + ([chart] if kind == "market_report" else [])]
        on = F.when(F.col(label) == kind, fires[0] if len(fires) == 1 else fires[0] | fires[1]).otherwise(on)
    return rows.withColumn("_n", normalise(text)).withColumn("supports", F.coalesce((F.col(label) != "other") & (n != "") & on, F.lit(False))).drop("_n")


def choose_type(titled: DataFrame, proposals: DataFrame, rules: DataFrame, *, chart: str) -> DataFrame:
    """(id, final_type, reason): the first proposal that its quote supports, else the type of the title if the title supports it, else other. titled has id, title, news_type."""
    quoted = supported(proposals, rules, label="topic", text="evidence", chart=chart).where("supports").groupBy("id").agg(F.min_by("topic", "pos").alias("_topic"))
    own = supported(titled, rules, label="news_type", text="title", chart=chart).join(quoted, "id", "left")
    reason = F.when(F.col("_topic").isNotNull(), "model_quote").when(F.col("supports"), "keyword_title").otherwise("unsupported")
    return own.withColumn("reason", reason).select("id", F.when(F.col("reason") == "model_quote", F.col("_topic")).when(F.col("reason") == "keyword_title", F.col("news_type")).otherwise("other").alias("final_type"), "reason")


#: A number with its sign unless a digit stands before that, dates to leave out, and month names of two languages.
NUMBER = r"(?<![0-9])[+\-−–]?[0-9]+(?:[.,][0-9]+)*"
ISO_DATE = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?\b"
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?|gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre"
LONG_DATE = rf"(?i)\b[0-9]{{1,2}}\s+(?:{MONTHS})\s+[0-9]{{4}}\b"


def numbers(c: Column | str) -> Column:
    """Distinct numbers of a text without its dates, as doubles rounded to six places.

    Of a comma and a point the last is the decimal mark; commas alone are decimal marks; what is no number then is left out.
    Minus signs and dashes of Unicode count as minus.
    """
    c = F.col(c) if isinstance(c, str) else c
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), ISO_DATE, " "), LONG_DATE, " ")
    found = F.regexp_extract_all(plain, F.lit(NUMBER), F.lit(0))

    def value(x: Column) -> Column:
        x = F.ltrim(F.translate(x, "−–", "--"), F.lit("+"))
        both = x.contains(",") & x.contains(".")
        european = F.length(F.substring_index(x, ",", -1)) < F.length(F.substring_index(x, ".", -1))
        y = F.when(both & european, F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(both, F.replace(x, F.lit(","), F.lit(""))).otherwise(F.replace(x, F.lit(","), F.lit(".")))
        return F.round(y.try_cast("double"), 6)

    return F.array_distinct(F.array_compact(F.transform(found, value)))


def ungrounded_numbers(sentence: Column | str, source: Column | str) -> Column:
    return F.array_except(numbers(sentence), numbers(source))


def shingle_pairs(quotes: DataFrame, bodies: DataFrame, *, width: int = 5) -> DataFrame:
    """(item_id, doc_id) that share a run of `width` normalised words: an equi-join on runs, not on all pairs. quotes has item_id and quote, bodies doc_id and body.

    Runs are 64-bit hashes of the hashes of their words, so that no run is ever spelt out.
    """
    def runs(h: Column) -> Column:
        return F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(width)])))

    def all_runs(text: str) -> Column:
        # the words are bound once, not split and hashed anew for every run
        words = F.transform(F.split(normalise(text), " "), lambda w: F.xxhash64(w))
        return F.array_distinct(F.get(F.transform(F.array(words), runs), F.lit(0)))

    q = quotes.select("item_id", F.explode(all_runs("quote")).alias("run"))
    d = bodies.select("doc_id", F.explode(all_runs("body")).alias("run"))
    return d.join(q, "run").select("item_id", "doc_id").distinct()


def verify_facts(facts: DataFrame, *, keys: list[str], known: Column, quote: str, body: str, sentence: str, sources: str, vocabulary: list[str], most: int = 3) -> DataFrame:
    """facts plus failure ('' if none) and kept: by group and `pos`, the first `most` facts that pass.

    A fact fails by an unknown source, a quote that is not verbatim in its source, numbers that no source of the group
    holds, or words of `vocabulary` that none holds. Facts after the last kept one are not looked at (failure null).
    """
    bad_source = F.when(~known, "unknown_id").when(~verbatim(body, quote), "quote")
    bad_numbers = F.when(F.size(ungrounded_numbers(sentence, sources)) > 0, "numbers")
    bad_words = F.when(F.size(ungrounded_words(sentence, sources, vocabulary)) > 0, "words")
    x = facts.withColumn("failure", F.concat_ws(" ", bad_source, bad_numbers, bad_words)).withColumn("_ok", F.col("failure") == "")
    before = F.coalesce(F.sum(F.col("_ok").cast("int")).over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = before < most
    return x.withColumn("_seen", seen).withColumn("kept", F.col("_ok") & F.col("_seen")).withColumn("failure", F.when(F.col("_seen"), F.col("failure"))).drop("_ok", "_seen")


def verbatim(body: Column | str, quote: Column | str) -> Column:
    """Whether the quote stands in the body, white space, accents, case and quote marks aside."""
    return F.coalesce((F.length(normalise(quote)) > 0) & normalise(body).contains(normalise(quote)), F.lit(False))


def ungrounded_words(sentence: Column | str, source: Column | str, vocabulary: list[str]) -> Column:
    """Words of a vocabulary that the sentence uses and the source lacks."""
    pattern = r"\b(" + "|".join(vocabulary) + r")\b"
    used = F.array_distinct(F.regexp_extract_all(F.lower(sentence), F.lit(pattern), 1))
    return F.filter(used, lambda w: ~F.lower(source).contains(w))


def reports_move(texts: DataFrame, *, text: str = "title", near: str = r"\b(?:margin|revenue|ebitda)\b", reach: int = 60, moves: tuple[str, ...] = (), deal: str = "(?!)", deal_verb: str = "(?!)", cue: str = "(?!)") -> DataFrame:
    """texts plus reports_move: whether the normalised text tells of the price's own move.

    It does by a signed or bracketed percentage that no metric word precedes within `reach` characters, or by one of the
    patterns `moves`; where the text speaks of a sale (`deal`) and has no price cue, a hit that holds `deal_verb` does not
    count. Positions decide, so this is an Arrow job: `mapInPandas` over the rows as they stand.
    """
    import re

    percent = re.compile(r"[(\[]?\s*[+\-−–]?\s*[0-9]+(?:[.,][0-9]+)?\s*%\s*[)\]]?")
    metric, sale, verb, price = (re.compile(x, re.I) for x in (near, deal, deal_verb, cue))
    patterns = [re.compile(m, re.I) for m in moves]

    def moved(s: str) -> bool:
        for m in percent.finditer(s):
            if re.search(r"[+\-−–(]", m.group()) and not metric.search(s[max(0, m.start() - reach) : m.start()]):
                return True
        excused = bool(sale.search(s)) and not price.search(s)
        return any((hit := p.search(s)) and not (excused and verb.search(hit.group())) for p in patterns)

    def flag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.drop(columns="_n").assign(reports_move=[moved(s or "") for s in x["_n"]])

    return texts.withColumn("_n", normalise(text)).mapInPandas(flag, texts.schema.simpleString()[7:-1] + ",reports_move boolean")


def scheduled(news_type: str, text: str, *, always: list[str], never: list[str], dated: dict[str, str]) -> Column:
    """Whether news is due by a calendar: always or never by its type, by a date pattern in the normalised text for the types of `dated`, else null."""
    out = F.when(F.col(news_type).isin(always), F.lit(True)).when(F.col(news_type).isin(never), F.lit(False))
    for kind, pattern in dated.items():
        out = out.when(F.col(news_type) == kind, F.coalesce(normalise(text).rlike(pattern), F.lit(False)))
    return out


CHECKS = ["quote_ok", "figure_ok", "adjective_ok", "numbers_ok", "words_ok"]


def output_checks(rows: DataFrame, *, vocabulary: list[str]) -> DataFrame:
    """rows plus the five checks of a model's sentence and all_ok, their conjunction.

    rows has sentence, quote, figure, adjective, title and source: the quote and the figure stand in the source but for
    white space, the adjective in the title in any case, the sentence's numbers and its words of the vocabulary in the source.
    An empty quote, figure or adjective fails.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    held = lambda a, b: (a != "") & b.contains(a)
    checks = {
        "quote_ok": held(plain("quote"), plain("source")), "figure_ok": held(plain("figure"), plain("source")), "adjective_ok": held(F.lower(F.coalesce("adjective", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))),
        "numbers_ok": F.size(ungrounded_numbers("sentence", "source")) == 0, "words_ok": F.size(ungrounded_words("sentence", "source", vocabulary)) == 0,
    }
    return rows.withColumns(checks).withColumn("all_ok", F.expr(" and ".join(CHECKS)))


def validated(articles: DataFrame, answers: DataFrame, proposals: DataFrame, candidates: DataFrame, *, topics: list[str], most: int = 3) -> DataFrame:
    """(id, errors) of each answer, in this order: a company that is no candidate, its evidence, the number of topics, topics, confidences, evidence, repeats, the primary topic, its place, the summary.

    answers has id, ticker, company_name, company_evidence, primary_topic, summary; proposals (id, pos, topic, confidence,
    evidence); candidates (id, cod, name), of which ticker and name must be one, case and accents aside. Company evidence is
    verbatim in title or body, that of topics in the body.
    """
    pair = candidates.select("id", F.lower("cod").alias("_ticker"), normalise("name").alias("_name"), F.lit(True).alias("_pair")).distinct()
    x = answers.join(articles.select("id", "title", "body"), "id").withColumns({"_ticker": F.lower(F.trim("ticker")), "_name": normalise("company_name")}).join(pair, ["id", "_ticker", "_name"], "left")
    controlled = lambda c: F.coalesce(c.isin(topics), F.lit(False))
    by_id = proposals.join(articles.select("id", "body"), "id").groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("topic").alias("_d"), F.min_by("topic", "pos").alias("_first"), F.bool_or(~controlled(F.col("topic"))).alias("_topic"),
        F.bool_or(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))).alias("_confidence"), F.bool_or(~verbatim("body", "evidence")).alias("_evidence"))
    x = x.join(by_id, "id", "left")
    primary = F.col("primary_topic")
    errors = {
        "company is no candidate": F.col("_pair").isNull(), "company evidence": ~verbatim(F.concat_ws("\n", "title", "body"), "company_evidence"), "topic count": F.col("n").isNull() | (F.col("n") > most), "topic": F.col("_topic"), "confidence": F.col("_confidence"), "evidence": F.col("_evidence"),
        "topics repeat": F.col("n") != F.col("_d"), "primary topic": ~controlled(primary), "primary is not first": F.col("n").isNotNull() & ~primary.eqNullSafe(F.col("_first")), "summary": F.coalesce(F.trim("summary"), F.lit("")) == "",
    }
    return x.select("id", F.array_compact(F.array(*[F.when(cond, F.lit(e)) for e, cond in errors.items()])).alias("errors"))


def candidates(articles: DataFrame, names: DataFrame, *, text: str = "body", limit: int = 30) -> DataFrame:
    """Names found in title or body: title hits first, then body hits, longer names, code; the first `limit` of each article."""
    from tidemark.operators.tape import match_names

    both = articles.withColumn("both", F.concat_ws(" ", "title", text))
    found = match_names(both, names, text="both").join(articles, "id").join(names.select("cod", "name"), "cod")
    found = found.withColumn("in_title", F.col("title").contains(F.col("name"))).withColumn("hits", F.expr(f"(length({text}) - length(replace({text}, name, ''))) / length(name)").cast("long"))
    w = Window.partitionBy("id").orderBy(F.desc("in_title"), F.desc("hits"), F.desc(F.length("name")), "cod")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("id", "cod", "in_title", "hits", "place")
