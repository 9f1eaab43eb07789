"""Checks of what a model says about a company's results: nested outputs taken apart, checked by kind and put together again.

Grounding never gathers the sources of a group: the numbers and watched words of a claim are rows that an anti-join holds
against those of the group's articles, and a quote meets the one article that it cites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.text import normalise, numbers, verbatim
from tidemark.sources.files import written

FACT = "struct<text:string,quote:string,article_id:bigint>"
METRIC = "struct<name:string,value:string,comparison:string,base:string,note:string>"
INDICATOR = "struct<name:string,state:string,text:string,quote:string,article_id:bigint>"
#: Kinds of claims in the order in which they are judged.
KINDS = ["fact", "metric", "guidance", "changed", "impact", "indicator"]
STATES = ["for", "neutral", "against", "not_cited"]
EFFECTS = ["stronger", "unchanged", "weaker"]
#: What takes the place of a text that fails.
FALLBACK = {"changed": "The comparison with the quarter before cannot be verified.", "impact": "The effect on the thesis cannot be verified.", "indicator": "The quote cannot be verified.", "not_cited": "Not cited in this quarter's articles."}


def blank(c: Column | str) -> Column:
    """Trimmed text; null for nothing."""
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(t != "", t)


def tokens(text: Column, vocabulary: list[str], *, whole: bool) -> Column:
    """The numbers of a text and the vocabulary's words in it (whole words, or wherever they stand), as an array of strings."""
    low = F.lower(text)
    if whole:
        used = F.array_distinct(F.regexp_extract_all(low, F.lit(r"\b(" + "|".join(vocabulary) + r")\b"), 1))
    else:
        used = F.filter(F.array(*map(F.lit, vocabulary)), lambda w: low.contains(w))
    return F.concat(F.transform(numbers(text), lambda n: F.concat(F.lit("#"), n.cast("string"))), used)


def source_tokens(articles: DataFrame, group: list[str], vocabulary: list[str]) -> DataFrame:
    """Distinct (group, token) of titles and bodies: what a claim about the group may say."""
    text = F.concat_ws("\n", "title", "body")
    return articles.select(*group, F.explode(tokens(text, vocabulary, whole=False)).alias("_token")).distinct()


def ungrounded(claims: DataFrame, articles: DataFrame, *, item: list[str], group: list[str], text: str, vocabulary: list[str]) -> DataFrame:
    """(item, bad_numbers, bad_words): for each claim that has any, the numbers and watched words that no article of its group holds."""
    said = claims.select(*dict.fromkeys([*item, *group]), F.explode(tokens(F.coalesce(text, F.lit("")), vocabulary, whole=True)).alias("_token"))
    missing = said.join(source_tokens(articles, group, vocabulary), [*group, "_token"], "left_anti")
    number = F.col("_token").startswith("#")
    return missing.groupBy(*item).agg(F.sort_array(F.collect_set(F.when(number, F.substring("_token", 2, 40)))).alias("bad_numbers"), F.sort_array(F.collect_set(F.when(~number, F.col("_token")))).alias("bad_words"))


def taken_apart(outputs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each claim of each output: kind, pos, name, state, said (what is checked), text, quote, article_id, value, comparison, base, note.

    outputs has the keys, relevant, facts, metrics, guidance, changed, impact (struct of effect and text), indicators and
    thesis, the names that indicators are wanted for: each gets one row, from the last indicator of its name.
    """
    none = F.lit(None).cast("string")

    def row(kind: str, pos: Column, **kw: Column) -> Column:
        fields = {c: kw.get(c, none).cast("string") for c in ("name", "state", "said", "text", "quote", "value", "comparison", "base", "note")}
        return F.struct(F.lit(kind).alias("kind"), pos.cast("int").alias("pos"), *[v.alias(c) for c, v in fields.items()], kw.get("article_id", none).cast("long").alias("article_id"))

    def fact(x: Column, i: Column) -> Column:
        return row("fact", i, said=F.trim(x["text"]), text=F.trim(x["text"]), quote=F.trim(x["quote"]), article_id=x["article_id"])

    def metric(x: Column, i: Column) -> Column:
        base = F.when(x["base"].isin("y/y", "q/q"), x["base"])
        parts = [F.trim(x[c]) for c in ("name", "value", "comparison")]
        return row("metric", i, name=parts[0], value=parts[1], comparison=parts[2], base=base, note=blank(x["note"]), said=F.concat_ws(" ", *parts, blank(x["note"])))

    def indicator(name: Column, i: Column) -> Column:
        x = F.try_element_at(F.filter(F.coalesce("indicators", F.array().cast(f"array<{INDICATOR}>")), lambda r: F.trim(r["name"]) == name), F.lit(-1))
        state = F.when(F.trim(x["state"]).isin(STATES), F.trim(x["state"])).otherwise("not_cited")
        cited = state != "not_cited"
        text = F.coalesce(blank(x["text"]), F.lit(FALLBACK["not_cited"]))
        return row("indicator", i, name=name, state=state, text=text, said=F.when(cited, text), quote=F.when(cited, blank(x["quote"])), article_id=F.when(cited, x["article_id"]))

    guidance = F.when(~F.trim("guidance").isin("", "null", "None"), F.trim("guidance"))
    effect = F.when(F.trim(F.col("impact")["effect"]).isin(EFFECTS), F.trim(F.col("impact")["effect"])).otherwise("unchanged")
    free = F.array(row("guidance", F.lit(0), said=guidance, text=guidance), row("changed", F.lit(0), said=F.trim("changed"), text=F.trim("changed")), row("impact", F.lit(0), said=F.trim(F.col("impact")["text"]), text=F.trim(F.col("impact")["text"]), state=effect))
    empty = F.array().cast(f"array<{FACT}>"), F.array().cast(f"array<{METRIC}>")
    claims = F.concat(F.transform(F.coalesce("facts", empty[0]), fact), F.transform(F.coalesce("metrics", empty[1]), metric), free, F.transform("thesis", indicator))
    return outputs.select(*keys, F.coalesce("relevant", F.lit(False)).alias("relevant"), F.inline(claims))


def verify_quarters(outputs: DataFrame, articles: DataFrame, *, keys: list[str], group: list[str], vocabulary: list[str], most_facts: int = 3, most_metrics: int = 4) -> DataFrame:
    """outputs with only what their articles bear out, and what failed.

    A fact fails by an article that the group does not have, a quote that is not verbatim in its article, numbers or
    watched words that no article of the group holds; the first `most_facts` that pass stay and those after them are not
    looked at. Metrics likewise, and a value without a digit must stand in some article. Guidance that fails goes;
    other free texts that fail give way to a fixed one. An indicator that is cited and fails falls back to not_cited.
    An output stays relevant if it says so and a fact stays. Returns the keys, relevant, facts, metrics, guidance,
    changed, impact, indicators, failures, dropped_facts, dropped_metrics, dropped_indicators and dropped_fields.
    Articles have the group, article_id, title and body.
    """
    item = [*keys, "kind", "pos"]
    claims = written(taken_apart(outputs, keys))
    bad = ungrounded(claims, articles, item=item, group=group, text="said", vocabulary=vocabulary)
    bodies = articles.select(*group, "article_id", F.col("body").alias("_body"), F.lit(True).alias("_known"))
    x = claims.join(bodies, [*group, "article_id"], "left").withColumn("_verbatim", verbatim("_body", "quote")).drop("_body")
    # values of metrics in words: few, each looked for in the articles of its group
    worded = claims.where((F.col("kind") == "metric") & (F.col("value") != "") & ~F.col("value").rlike("[0-9]")).select(*item, *[g for g in group if g not in keys], "value")
    found = worded.join(articles.select(*group, normalise(F.concat_ws("\n", "title", "body")).alias("_all")), group).where(F.col("_all").contains(normalise("value"))).select(*item).distinct().withColumn("_said", F.lit(True))
    x = x.join(bad, item, "left").join(found, item, "left")

    kind, known = F.col("kind"), F.coalesce("_known", F.lit(False))
    quoted = kind.isin("fact") | ((kind == "indicator") & (F.col("state") != "not_cited"))
    wrong_number = F.coalesce(F.size("bad_numbers") > 0, F.lit(False))
    wrong_word = F.coalesce(F.size("bad_words") > 0, F.lit(False))
    unsaid = (kind == "metric") & (F.col("value") != "") & ~F.col("value").rlike("[0-9]") & F.col("_said").isNull() & ~wrong_number & ~wrong_word
    reasons = F.array_compact(F.array(
        F.when(quoted & ~known, "unknown article"), F.when(quoted & known & ~F.col("_verbatim"), "quote not verbatim"), F.when(wrong_number, "numbers"), F.when(wrong_word & ~((kind != "fact") & (kind != "indicator") & wrong_number), "words"), F.when(unsaid, "value not said")))
    x = x.withColumn("_reasons", reasons).withColumn("_ok", F.size("_reasons") == 0)
    # whether a claim is reached: facts and metrics are looked at until enough have passed
    order = Window.partitionBy(*keys, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum(F.col("_ok").cast("int")).over(order), F.lit(0))
    most = F.when(kind == "fact", most_facts).when(kind == "metric", most_metrics).otherwise(F.lit(2**30))
    x = x.withColumn("_passed", passed).where(F.col("_passed") < most)
    label = F.when(kind.isin("fact", "metric"), F.concat(kind, F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(kind == "indicator", F.concat_ws(" ", kind, "name")).otherwise(kind)
    at = F.array_position(F.array(*map(F.lit, KINDS)), kind)
    failed = F.when(~F.col("_ok"), F.struct(at.alias("k"), "pos", F.concat(label, F.lit(": "), F.concat_ws(", ", "_reasons")).alias("said")))

    def entries(k: str, *fields: Column | str, kept: bool = True) -> Column:
        wanted = (kind == k) & (F.col("_ok") if kept else F.lit(True))
        return F.transform(F.sort_array(F.collect_list(F.when(wanted, F.struct("pos", F.struct(*fields).alias("x"))))), lambda r: r["x"])

    def one(k: str, value: Column) -> Column:
        return F.max(F.when(kind == k, value))

    text = F.col("text")
    lost = (kind == "indicator") & ~F.col("_ok")
    indicator = [F.when(lost, "not_cited").otherwise(F.col("state")).alias("state"), F.when(lost, FALLBACK["indicator"]).otherwise(text).alias("text"), F.when(~lost, F.col("quote")).alias("quote"), F.when(~lost, F.col("article_id")).alias("article_id")]
    dropped = lambda k: F.count_if((kind == k) & ~F.col("_ok"))
    out = x.groupBy(*keys).agg(
        F.bool_or("relevant").alias("_relevant"), entries("fact", "text", "quote", "article_id").alias("facts"), entries("metric", "name", "value", "comparison", "base", "note").alias("metrics"),
        one("guidance", F.when(F.col("_ok"), text)).alias("guidance"), one("changed", F.when(F.col("_ok"), text).otherwise(FALLBACK["changed"])).alias("changed"),
        one("impact", F.struct(F.col("state").alias("effect"), F.when(F.col("_ok"), text).otherwise(FALLBACK["impact"]).alias("text"))).alias("impact"),
        entries("indicator", "name", *indicator, kept=False).alias("indicators"), F.transform(F.sort_array(F.collect_list(failed)), lambda r: r["said"]).alias("_failures"),
        dropped("fact").alias("dropped_facts"), dropped("metric").alias("dropped_metrics"), dropped("indicator").alias("dropped_indicators"),
        F.sort_array(F.collect_set(F.when(kind.isin("guidance", "changed", "impact") & ~F.col("_ok"), kind))).alias("dropped_fields"))
    more = F.array_compact(F.array(F.when(~F.col("_relevant"), "not relevant"), F.when(F.size("facts") == 0, "no fact left")))
    return out.select(*keys, (F.col("_relevant") & (F.size("facts") > 0)).alias("relevant"), "facts", "metrics", "guidance", "changed", "impact", "indicators", F.concat("_failures", more).alias("failures"), "dropped_facts", "dropped_metrics", "dropped_indicators", "dropped_fields")


def best_attempt(verified: DataFrame, *, keys: list[str], attempt: str = "attempt") -> DataFrame:
    """Of two attempts by key the first, unless something of it was dropped or it is not relevant and the second keeps as many facts or more. What is not relevant keeps no facts."""
    v = F.struct(*[c for c in verified.columns if c not in keys])
    x = verified.groupBy(*keys).agg(F.any_value(F.when(F.col(attempt) == 1, v), True).alias("a"), F.any_value(F.when(F.col(attempt) == 2, v), True).alias("b"))
    a, b = F.col("a"), F.col("b")
    lost = (a["dropped_facts"] + a["dropped_metrics"] + a["dropped_indicators"] + F.size(a["dropped_fields"]) > 0) | ~a["relevant"]
    second = a.isNull() | (b.isNotNull() & (F.size(a["failures"]) > 0) & lost & (F.size(b["facts"]) >= F.size(a["facts"])))
    out = x.select(*keys, F.when(second, b).otherwise(a).alias("v")).select(*keys, "v.*")
    return out.withColumn("facts", F.when(F.col("relevant"), F.col("facts")).otherwise(F.array().cast(dict(out.dtypes)["facts"])))


def latest_cited(verified: DataFrame, theses: DataFrame, *, key: str = "cod", order: str = "no", label: str = "quarter") -> DataFrame:
    """(key, indicator, state, text, quote, article_id, quarter, older) for every indicator of every thesis.

    The assessment of the latest relevant quarter if it cites the indicator, else the latest that does, with its quarter
    named in the text; not_cited without any. Every relevant quarter assesses every indicator, so one aggregation knows both.
    """
    i = verified.where("relevant").select(key, order, label, F.explode("indicators").alias("i"))
    cited = (F.col("i.state") != "not_cited") & F.col("i.quote").isNotNull()
    x = i.groupBy(key, F.col("i.name").alias("indicator")).agg(F.max(order).alias("latest"), F.max(F.when(cited, F.struct(F.col(order).alias("no"), F.col(label).alias("label"), "i.state", "i.text", "i.quote", "i.article_id"))).alias("x"))
    wanted = theses.select(F.col("ticker").alias(key), F.explode("indicators").alias("indicator")).distinct()
    older = F.col("x.no") < F.col("latest")
    return wanted.join(x, [key, "indicator"], "left").select(
        key, "indicator", F.coalesce("x.state", F.lit("not_cited")).alias("state"), F.when(older, F.concat(F.rtrim(F.col("x.text"), F.lit(".")), F.lit(" (noted in "), F.col("x.label"), F.lit(")."))).otherwise(F.col("x.text")).alias("text"),
        F.col("x.quote").alias("quote"), F.col("x.article_id").alias("article_id"), F.col("x.label").alias("quarter"), F.coalesce(older, F.lit(False)).alias("older"))


def coverage(verified: DataFrame, quarters: DataFrame, companies: DataFrame, *, least: int = 2, recent: int = 2) -> DataFrame:
    """(cod, n, missing, coverage): relevant quarters, labels of those without, and insufficient if fewer than `least` or none of the last `recent`. quarters is one row for each quarter, companies has cod."""
    grid = companies.select("cod").distinct().crossJoin(F.broadcast(quarters.select("no", "quarter", F.max("no").over(Window.partitionBy(F.lit(1))).alias("last"))))  # the quarters are a few rows
    has = F.col("has").isNotNull()
    x = grid.join(verified.where("relevant").select("cod", "no", F.lit(True).alias("has")), ["cod", "no"], "left").groupBy("cod").agg(
        F.count_if(has).alias("n"), F.bool_or(has & (F.col("no") > F.col("last") - recent)).alias("_late"), F.sort_array(F.collect_list(F.when(~has, F.col("quarter")))).alias("missing"))
    return x.select("cod", "n", "missing", F.when((F.col("n") < least) | ~F.col("_late"), "insufficient").otherwise("ok").alias("coverage"))


def quarter_entries(verified: DataFrame, articles: DataFrame, quarters: DataFrame, companies: DataFrame) -> DataFrame:
    """Every company and quarter: its facts with the source row of each (title, url, date), the sources in order of publication, the earliest date; or missing."""
    facts = verified.where("relevant").select("cod", "no", F.posexplode("facts").alias("pos", "f")).select("cod", "no", "pos", "f.*")
    source = F.struct("title", "url", F.col("pub_date").alias("date"))
    rows = facts.join(articles.select("cod", "no", "article_id", "title", "url", "pub_date"), ["cod", "no", "article_id"], "left")
    built = rows.groupBy("cod", "no").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct("text", "quote", "article_id", source.alias("source")).alias("x")))), lambda r: r["x"]).alias("facts"),
        F.transform(F.sort_array(F.collect_set(F.struct("pub_date", "article_id", source.alias("x")))), lambda r: r["x"]).alias("sources"), F.min("pub_date").alias("first_date"))
    grid = companies.select("cod").distinct().crossJoin(F.broadcast(quarters.select("no", "quarter")))  # the quarters are a few rows
    return grid.join(built, ["cod", "no"], "left").withColumn("missing", F.col("facts").isNull())


def metric_key(name: Column | str, rules: list[tuple[str, str, str]]) -> Column:
    """The key of the first rule whose pattern is in the normalised name and whose exception is not. rules are (key, pattern, exception or '')."""
    n = normalise(name)
    out = F.lit(None).cast("string")
    for key, pattern, other in reversed(rules):
        out = F.when(n.rlike(pattern) & ~(n.rlike(other) if other else F.lit(False)), key).otherwise(out)
    return out


def metric_table(verified: DataFrame, quarters: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(cod, metric, q0 ..): by metric and quarter, oldest first, the value and comparison of the first metric of that key with a value; n/a where the quarter has none, null where it is missing. quarters has no and k from 0."""
    m = verified.where("relevant").select("cod", "no", F.posexplode_outer("metrics").alias("pos", "m"))
    value = F.concat_ws(" ", F.regexp_replace("m.value", r"(?i)\s+(?:di\s+)?euro$", ""), blank("m.comparison"), F.when(blank("m.comparison").isNotNull(), F.col("m.base")))
    keyed = m.select("cod", "no", "pos", metric_key("m.name", rules).alias("metric"), F.when(F.col("m.value").isNotNull(), value).alias("value"))
    best = keyed.where("metric is not null and value is not null").groupBy("cod", "metric", "no").agg(F.min_by("value", "pos").alias("value"))
    k = F.broadcast(quarters.select("no", "k"))  # a few rows
    n = range(quarters.count())
    wide = best.join(k, "no").groupBy("cod", "metric").agg(*[F.max(F.when(F.col("k") == i, F.col("value"))).alias(f"q{i}") for i in n])
    there = verified.where("relevant").join(k, "no").groupBy("cod").agg(*[F.bool_or(F.col("k") == i).alias(f"h{i}") for i in n])
    return wide.join(there, "cod").select("cod", "metric", *[F.when(F.col(f"h{i}"), F.coalesce(f"q{i}", F.lit("n/a"))).alias(f"q{i}") for i in n])


def verify_fields(rows: DataFrame, articles: DataFrame, *, key: str, texts: dict[str, str], vocabulary: list[str]) -> DataFrame:
    """rows plus failures: for each named text (label -> column) whose numbers or watched words no article of the key holds, in the order of `texts`."""
    said = rows.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label"), F.trim(F.col(c)).alias("said")) for i, (label, c) in enumerate(texts.items())])).alias("t")).select(key, "t.*")
    bad = ungrounded(said, articles, item=[key, "pos", "label"], group=[key], text="said", vocabulary=vocabulary)
    what = F.concat(F.col("label"), F.lit(": "), F.concat_ws(", ", F.when(F.size("bad_numbers") > 0, "numbers"), F.when(F.size("bad_words") > 0, "words")))
    failed = bad.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", what.alias("x")))), lambda r: r["x"]).alias("failures"))
    return rows.join(failed, key, "left").withColumn("failures", F.coalesce("failures", F.array().cast("array<string>")))


def verify_aggregate(rows: DataFrame, articles: DataFrame, *, vocabulary: list[str], states: list[str], least: str = "insufficient", other: str = "unchanged") -> DataFrame:
    """(cod, state, summary, views, evolution, failures) of rows with state, summary, views (two count), evolution.

    A state outside the vocabulary becomes `other`, none at all `least`. Texts are checked against all articles of the company and
    stay; sentences of views about weights go, unless nothing would be left.
    """
    x = rows.withColumns({"_v1": F.coalesce(F.get("views", F.lit(0)), F.lit("")), "_v2": F.coalesce(F.get("views", F.lit(1)), F.lit(""))})
    x = verify_fields(x, articles, key="cod", texts={"summary": "summary", "views[0]": "_v1", "views[1]": "_v2", "evolution": "evolution"}, vocabulary=vocabulary)

    def unweighted(v: Column) -> Column:
        return F.coalesce(blank(F.regexp_replace(v, r"(?i)\bweight\b[^.]*\.?", "")), v)

    state = F.coalesce(blank("state"), F.lit(least))
    views = F.transform(F.slice("views", 1, 2), lambda v: unweighted(F.trim(v)))
    return x.select("cod", F.when(state.isin(states), state).otherwise(other).alias("state"), F.trim("summary").alias("summary"), views.alias("views"), F.trim("evolution").alias("evolution"), "failures")


def verify_decision(rows: DataFrame, articles: DataFrame, allowed: DataFrame, news: DataFrame, *, vocabulary: list[str]) -> DataFrame:
    """(cod, context, action, failures, n_news, news_from) of rows with cod, context, action, reason, pros (three count), risk, change.

    An action that the context does not allow gives way to its first; texts are checked against all articles of the
    company. allowed has (context, place, action), a few rows; news has (cod, n, since).
    """
    x = rows.join(F.broadcast(allowed.groupBy("context").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "action"))), lambda r: r["action"]).alias("_ok"))), "context")
    x = x.withColumns({f"_p{i}": F.coalesce(F.get("pros", F.lit(i)), F.lit("")) for i in range(3)})
    x = verify_fields(x, articles, key="cod", texts={"reason": "reason", **{f"pros[{i}]": f"_p{i}" for i in range(3)}, "risk": "risk", "change": "change"}, vocabulary=vocabulary)
    fits = F.array_contains("_ok", F.coalesce("action", F.lit("")))
    out = x.withColumn("failures", F.concat(F.when(fits, F.array().cast("array<string>")).otherwise(F.array(F.lit("action not allowed"))), "failures")).withColumn("action", F.when(fits, F.col("action")).otherwise(F.get("_ok", F.lit(0))))
    return out.join(news, "cod", "left").select("cod", "context", "action", "failures", F.coalesce("n", F.lit(0)).cast("long").alias("n_news"), F.col("since").alias("news_from"))
