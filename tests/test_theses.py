"""Verification of what models say of results, by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import theses as op

VOCABULARY = ["buy", "sell"]
SCHEMA = f"""cod string, quarter string, no int, attempt int, relevant boolean, facts array<{op.FACT}>, metrics array<{op.METRIC}>, guidance string, changed string,
    impact struct<effect:string,text:string>, indicators array<{op.INDICATOR}>, thesis array<string>"""
ARTICLES = [
    ("A", "Q1", 1, 10, "Ricavi a 12,5 milioni", "I ricavi sono  saliti a 12,5 milioni. Utile netto di 3 milioni, “solido”.", "2024-02-03", "u/10"),
    ("A", "Q1", 1, 11, "Conti", "Il titolo sale. Analysts say buy now.", "2024-02-01", "u/11"),
    ("A", "Q2", 2, 20, "Semestre", "Ebitda a 7 milioni e margine al 20%.", "2024-05-01", "u/20"),
    ("B", "Q1", 1, 30, "Altro", "Nulla da dire: 99.", "2024-02-02", "u/30"),
]
GOOD = ("ricavi saliti a 12.5", "ricavi sono saliti a 12,5 milioni", 10)


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(ARTICLES, "cod string, quarter string, no int, article_id long, title string, body string, pub_date string, url string").withColumn("pub_date", F.to_date("pub_date"))


def output(cod="A", quarter="Q1", no=1, attempt=1, relevant=True, facts=(), metrics=(), guidance=None, changed=None, impact=None, indicators=(), thesis=()):
    return (cod, quarter, no, attempt, relevant, list(facts) if facts is not None else None, list(metrics), guidance, changed, impact, list(indicators), list(thesis))


def verified(spark, articles, *outputs):
    return op.verify_quarters(spark.createDataFrame(list(outputs), SCHEMA), articles, keys=["cod", "quarter", "no", "attempt"], group=["cod", "quarter"], vocabulary=VOCABULARY)


def test_facts_fail_by_article_quote_number_and_word_and_three_stay(spark, articles):
    facts = [
        ("x", "y", 30), ("x", "ricavi scesi", 10), ("ricavi a 13", GOOD[1], 10), ("sell it", GOOD[1], 10), (" buy it ", "utile netto di 3 milioni, \"SOLIDO\"", 10),
        GOOD, ("99", "titolo", 11), ("sale", "Il titolo sale", 11), ("after", "unchecked", 99), ("x", "", 10),
    ]
    (r,) = verified(spark, articles, output(facts=facts)).collect()
    assert [(f.text, f.article_id) for f in r.facts] == [("buy it", 10), (GOOD[0], 10), ("sale", 11)] and r.relevant
    assert r.failures == ["fact[0]: unknown article", "fact[1]: quote not verbatim", "fact[2]: numbers", "fact[3]: words", "fact[6]: numbers"] and r.dropped_facts == 5


def test_metrics_free_texts_and_indicators(spark, articles):
    metrics = [("Ricavi", "12,5 milioni", "", "a/a", " "), ("Utile", "31", "", "y/y", None), ("Utile", "solido", "", "q/q", None), ("Utile", "liquido", "", None, None), ("Nota", "3", "", None, "sell"), *[("Ebitda", "3", "", "y/y", None)] * 4]
    indicators = [("margin", "for", "old", "x", 10), ("margin", "for", "utile 3", "Utile netto", 10), ("debt", "against", "debito", "non detto", 10), ("cash", "odd", "t", "q", 1), ("other", "for", "t", "Il titolo", 11)]
    o = output(facts=[GOOD], metrics=metrics, guidance=" sees 77 ", changed="sell", impact=("great", "up 12.5"), indicators=indicators, thesis=["margin", "debt", "cash", "none"])
    (r,) = verified(spark, articles, o).collect()
    assert [(m.name, m.value, m.base, m.note) for m in r.metrics] == [("Ricavi", "12,5 milioni", None, None), ("Utile", "solido", "q/q", None), ("Ebitda", "3", "y/y", None), ("Ebitda", "3", "y/y", None)]
    assert (r.guidance, r.changed, tuple(r.impact), r.dropped_fields) == (None, op.FALLBACK["changed"], ("unchanged", "up 12.5"), ["changed", "guidance"])
    assert [(i.name, i.state, i.quote, i.article_id) for i in r.indicators] == [("margin", "for", "Utile netto", 10), ("debt", "not_cited", None, None), ("cash", "not_cited", None, None), ("none", "not_cited", None, None)]
    assert r.indicators[1].text == op.FALLBACK["indicator"] and r.indicators[3].text == op.FALLBACK["not_cited"]
    assert r.failures == ["metric[1]: numbers", "metric[3]: value not said", "metric[4]: words", "guidance: numbers", "changed: words", "indicator debt: quote not verbatim"]
    assert (r.dropped_metrics, r.dropped_indicators) == (3, 1)


def test_empty_outputs_and_relevance(spark, articles):
    rows = verified(spark, articles, output(facts=None), output("A", "Q2", 2, relevant=False, facts=[("7", "Ebitda a 7 milioni", 20)]), output("C", "Q9", 9, facts=[GOOD])).collect()
    got = {r.cod + r.quarter: (r.relevant, len(r.facts), r.failures) for r in rows}
    assert got == {"AQ1": (False, 0, ["no fact left"]), "AQ2": (False, 1, ["not relevant"]), "CQ9": (False, 0, ["fact[0]: unknown article, numbers", "no fact left"])}
    assert verified(spark, articles, output()).where("false").count() == 0


def test_the_better_attempt_stays(spark, articles):
    bad = ("x", "y", 30)
    v = verified(
        spark, articles, output(facts=[bad, GOOD]), output(attempt=2, facts=[GOOD, GOOD]), output("A", "Q2", 2, facts=[("7", "Ebitda a 7 milioni", 20)]), output("A", "Q2", 2, attempt=2, facts=[]),
        output("B", facts=[("99", "Nulla da dire", 30), bad]), output("B", attempt=2, facts=[bad]), output("C", relevant=False, facts=[GOOD]), output("C", attempt=2, relevant=False),
    )
    got = {r.cod + r.quarter: (r.attempt, r.relevant, len(r.facts)) for r in op.best_attempt(v, keys=["cod", "quarter", "no"]).collect()}
    assert got == {"AQ1": (2, True, 2), "AQ2": (1, True, 1), "BQ1": (1, True, 1), "CQ1": (2, False, 0)}


def test_roll_ups_over_quarters(spark, articles):
    q1 = output(facts=[GOOD, ("sale", "Il titolo sale", 11)], metrics=[("Ricavi netti", "12,5 milioni di euro", "3", "y/y", None), ("Fatturato", "12,5", "", None, None)], indicators=[("margin", "for", "utile 3.", "Utile netto", 10)], thesis=["margin", "debt"])
    q2 = output("A", "Q2", 2, facts=[("7", "Ebitda a 7 milioni", 20)], metrics=[("EBITDA margin", "20%", "", None, None), ("Ebitda", "7", "", None, None)], indicators=[("debt", "against", "7", "Ebitda a 7", 20)], thesis=["margin", "debt"])
    v = op.best_attempt(verified(spark, articles, q1, q2), keys=["cod", "quarter", "no"])
    theses = spark.createDataFrame([("A", ["margin", "debt"]), ("Z", ["cash"])], "ticker string, indicators array<string>")
    got = {(r.cod, r.indicator): (r.state, r.text, r.quarter, r.older) for r in op.latest_cited(v, theses).collect()}
    assert got == {("A", "margin"): ("for", "utile 3 (noted in Q1).", "Q1", True), ("A", "debt"): ("against", "7", "Q2", False), ("Z", "cash"): ("not_cited", None, None, False)}
    quarters = spark.createDataFrame([(n, f"Q{n}", n - 1) for n in (1, 2, 3, 4)], "no int, quarter string, k int")
    companies = spark.createDataFrame([("A",), ("Z",)], "cod string")
    assert {r.cod: (r.n, r.missing, r.coverage) for r in op.coverage(v, quarters, companies).collect()} == {"A": (2, ["Q3", "Q4"], "insufficient"), "Z": (0, ["Q1", "Q2", "Q3", "Q4"], "insufficient")}
    assert op.coverage(v, quarters.where("no < 4"), companies).where("cod = 'A'").first().coverage == "ok"
    e = {(r.cod, r.quarter): r for r in op.quarter_entries(v, articles, quarters, companies).collect()}
    assert len(e) == 8 and e["Z", "Q1"].missing and not e["A", "Q1"].missing and [s.url for s in e["A", "Q1"].sources] == ["u/11", "u/10"] and [f.source.url for f in e["A", "Q1"].facts] == ["u/10", "u/11"]
    rules = [("revenue", "^(ricavi|fatturato)", ""), ("ebitda", "ebitda", "margin|/"), ("margin", "margin", "")]
    m = {r.metric: tuple(r)[2:] for r in op.metric_table(v, quarters, rules).collect()}
    assert m == {"revenue": ("12,5 milioni 3 y/y", "n/a", None, None), "ebitda": ("n/a", "7", None, None), "margin": ("n/a", "20%", None, None)}


def test_aggregates_and_decisions(spark, articles):
    rows = [("A", "good", "12,5 e 8", ["Weight 3% here. Utile 3", "weight", "sell"], "7", "hold", "portfolio"), ("B", None, "99", ["sell"], None, "open", "watchlist"), ("C", "weakened", "", [], "", None, "watchlist")]
    x = spark.createDataFrame(rows, "cod string, state string, summary string, views array<string>, evolution string, action string, context string")
    got = {r.cod: (r.state, r.views, r.failures) for r in op.verify_aggregate(x, articles, vocabulary=VOCABULARY, states=["strengthened", "unchanged", "weakened", "insufficient"]).collect()}
    assert got == {"A": ("unchanged", ["Utile 3", "weight"], ["summary: numbers"]), "B": ("insufficient", ["sell"], ["views[0]: words"]), "C": ("weakened", [], [])}
    allowed = spark.createDataFrame([("portfolio", 1, "add"), ("portfolio", 2, "sell"), ("watchlist", 2, "watch"), ("watchlist", 1, "open")], "context string, place int, action string")
    news = spark.createDataFrame([("A", 3, "2024-01-01")], "cod string, n long, since string")
    x = x.withColumns({"reason": F.col("summary"), "pros": F.col("views"), "risk": F.lit("buy"), "change": F.lit("")})
    d = {r.cod: (r.action, r.failures, r.n_news) for r in op.verify_decision(x, articles, allowed, news, vocabulary=VOCABULARY).collect()}
    assert d == {"A": ("add", ["action not allowed", "reason: numbers", "pros[2]: words"], 3), "B": ("open", ["pros[0]: words", "risk: words"], 0), "C": ("open", ["action not allowed", "risk: words"], 0)}


def test_documents_are_not_shuffled_by_quarter(spark):
    """Four quarters meet the documents where these are, however large a table Spark takes them for."""
    import os

    from tidemark.fixtures import PRESS, CLAIMS, PRESS_SPARK, Tables

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    assert PRESS_SPARK != PRESS and CLAIMS.count(PRESS) > 2
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], "-1")
        spark.conf.set(keys[1], "false")
        for df in (Tables(spark, sf).press, Tables(spark, sf).claims):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
