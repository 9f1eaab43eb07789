"""Rules for headlines, model answers, candidates, indicators and ranks, by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import events, evidence, sentiment, text


def test_a_type_is_due_always_never_or_by_date(spark):
    rows = [("earnings", "x"), ("rating", "stacco 3"), ("capital", "Stàcco  il 3 maggio"), ("capital", "nothing"), ("capital", None), ("other", "stacco 3"), (None, "x")]
    df = spark.createDataFrame(rows, "t string, s string").select(text.scheduled("t", "s", always=["earnings"], never=["rating"], dated={"capital": "stacco (?:il )?[0-9]"}).alias("x"))
    assert [r.x for r in df.collect()] == [True, False, True, False, False, None, None]


def test_headlines_on_sales_need_a_price_cue(spark):
    titles = ["Alpha rises 3% on margin", "Stake sold, seller drops out", "Stake sold, share drops", "Stake sold, price drops", "margin (+3%)", "margin grows and the market and all the others and many more of them too (+3%)", "flat", None]
    df = text.reports_move(spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "id int, title string"), moves=(r"rises [0-9]+%", r"\w+ drops"), deal="stake sold", deal_verb="seller|price", cue="price")
    assert [r.reports_move for r in df.orderBy("id").collect()] == [True, False, True, True, False, True, False, False]


def test_output_checks_are_five_and_one(spark):
    source = "Solid quarter\nRevenue  of 12 million, says the chief"
    rows = [("up to 12", "Revenue of 12", "12 million", "SOLID", source), ("up to 13 idiot", "", "13", "weak", source), ("up", None, None, None, None)]
    df = text.output_checks(spark.createDataFrame(rows, "sentence string, quote string, figure string, adjective string, source string").withColumn("title", F.split_part("source", F.lit("\n"), F.lit(1))), vocabulary=["idiot"])
    got = [tuple(r[c] for c in [*text.CHECKS, "all_ok"]) for r in df.collect()]
    assert got[:2] == [(True,) * 6, (False,) * 6] and got[2][:3] == (False, False, False) and got[2][5] is False


ANSWER = "id string, ticker string, company_name string, company_evidence string, primary_topic string, summary string"
GOOD = ("fca", "Fiat  Chrysler", "FIAT Chrysler", "deal", "s")


def test_answers_are_validated_in_order(spark):
    articles = spark.createDataFrame([(i, "Fiat Chrysler", "The deal is done, says Fiat.") for i in "abcdefg"], "id string, title string, body string")
    candidates = spark.createDataFrame([(i, c, n) for i in "abcdefg" for c, n in (("FCA", "FIAT CHRYSLER"), ("F", "Fiat"))], "id string, cod string, name string")
    answers = [("a", *GOOD), ("b", "F", *GOOD[1:]), ("c", *GOOD[:2], "nowhere", "rating", " "), ("d", *GOOD), ("e", *GOOD), ("f", *GOOD[:3], "gossip", None), ("g", *GOOD)]
    topic = {"a": [("deal", 1.0, "deal is done")], "b": [("deal", 0.0, "THE deal")], "c": [("deal", 0.5, "deal")], "d": [("deal", 0.5, "deal"), ("deal", 0.5, "deal"), ("legal", 0.5, "deal"), ("rating", 0.5, "deal")], "e": [("deal", 1.5, "Fiat Chrysler")], "f": [("gossip", None, None)]}
    proposals = spark.createDataFrame([(i, k, *p) for i, x in topic.items() for k, p in enumerate(x)], "id string, pos int, topic string, confidence double, evidence string")
    got = {r.id: r.errors for r in text.validated(articles, spark.createDataFrame(answers, ANSWER), proposals, candidates, topics=["deal", "legal", "rating"]).collect()}
    assert got == {
        "a": [], "b": ["company is no candidate"], "c": ["company evidence", "primary is not first", "summary"], "d": ["topic count", "topics repeat"], "e": ["confidence", "evidence"],
        "f": ["topic", "confidence", "evidence", "primary topic", "summary"], "g": ["topic count"],
    }


def test_candidates_in_bodies_alone_come_after_titles(spark):
    articles = spark.createDataFrame([("1", "Alpha up", "Beta Beta Beta and Alpha; Gamma Ray"), ("2", "none", "Alphabet")], "id string, title string, body string")
    names = spark.createDataFrame([("A", "Alpha"), ("B", "Beta"), ("G", "Gamma Ray"), ("R", "Ray")], "cod string, name string")
    got = [(r.cod, r.in_title, r.hits, r.place) for r in text.candidates(articles, names).orderBy("id", "place").collect()]
    assert got == [("A", True, 1, 1), ("B", False, 3, 2), ("G", False, 1, 3), ("R", False, 1, 4)]
    assert text.candidates(articles, names, limit=2).count() == 2


def test_results_score_and_indicator_groups(spark):
    rows = [("Alpha: ricavi e utile", "alpha", True), ("Beta batte Alpha, conti", "Alpha", False), ("sconti", "x", False), (None, "x", False)]
    df = spark.createDataFrame(rows, "title string, name string, own boolean").select(evidence.results_score("title", "name", "own", "ricavi|utile|conti").alias("s"))
    assert [r.s for r in df.collect()] == [5, 1, 0, None]
    stories = spark.createDataFrame([("1", "A", "REACTED", 0.1), ("2", "A", "NO_REACTION", 0.1), ("3", "A", "DELAYED", -0.1), ("4", "Z", "REACTED", 1.0)], "id string, cod string, status string, peak_ret double")
    tags = spark.createDataFrame([("1", "debt"), ("3", "unknown")], "id string, indicator string")
    theses = spark.createDataFrame([("A", "debt"), ("A", "cash"), ("B", "debt")], "cod string, indicator string")
    got = {(r.cod, r.bucket): (r.n, r.n_reaction, r.n_already, r.n_none, r.up, r.down) for r in evidence.news_by_indicator(stories, tags, theses).collect()}
    assert got == {("A", "debt"): (1, 1, 0, 0, 1, 0), ("A", "cash"): (0,) * 6, ("A", "outside"): (2, 1, 0, 1, 0, 1), ("B", "debt"): (0,) * 6, ("B", "outside"): (0,) * 6}


def test_recalculation_names_what_changed(spark):
    state = "cod string, status string, action string, summary string"
    before = spark.createDataFrame([("A", "x", "hold", " s "), ("B", None, None, None), ("gone", "x", "y", "z")], state)
    after = spark.createDataFrame([("A", "x", "add", "s"), ("B", "y", None, "t"), ("new", "x", "y", "z")], state)
    was = spark.createDataFrame([("A", "i", "for"), ("A", "j", "for"), ("A", "old", "for")], "cod string, name string, state string")
    now = spark.createDataFrame([("A", "j", "against"), ("A", "i", "for"), ("A", "h", "for")], "cod string, name string, state string")
    got = {r.cod: tuple(r)[1:] for r in evidence.recalc_diff(before, after, was, now).collect()}
    assert got == {"A": (None, "hold>add", "h:->for,j:for>against", False), "B": ("->y", None, "", True)}


def test_first_list_wins_and_ranks_follow_size(spark):
    lists = spark.createDataFrame([(2, "two", ["a", "b"]), (1, "one", ["b", "c"]), (3, "none", [])], "pos int, sector string, tickers array<string>")
    assert {r.cod: r.sector for r in sentiment.sector_of(spark.createDataFrame([("a",), ("b",), ("x",)], "cod string"), lists).collect()} == {"a": "two", "b": "one", "x": None}
    judged = spark.createDataFrame([("p", "s")] * 3 + [("q", "s"), ("q", "t")] * 2 + [("o", "s")] * 3, "t string, status string")
    assert sorted({(r.place, r.t) for r in events.status_shares(judged, "t").collect()}) == [(1, "q"), (2, "o"), (3, "p")]


@pytest.mark.parametrize(("x", "want"), [(2.5, 2.0), (3.5, 4.0), (-0.5, 0.0)])
def test_percents_round_half_to_even(spark, x, want):
    assert spark.range(1).select(F.bround(F.lit(x), 0).alias("x")).first().x == want
