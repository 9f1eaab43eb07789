"""Rules of the tape and of verdicts on hand-made rows."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import desk, events, evidence, sentiment, tape, text
from tidemark.registry import oracle_sql, queries

DAY = date(2024, 1, 1)


def quotes(spark, lasts, cod="A", refs=None):
    refs = refs or lasts
    rows = [(cod, DAY + timedelta(i), float(x), float(r), float(x), float(x), float(x), 1.0) for i, (x, r) in enumerate(zip(lasts, refs, strict=True))]
    return spark.createDataFrame(rows, "cod string, d date, last double, ref double, open double, low double, high double, qty double")


def test_invalid_quotes_leave_no_gap(spark):
    got = [(r.idx, r.ret) for r in tape.sessions(quotes(spark, [10, 0, 11])).orderBy("d").collect()]
    assert got == [(1, None), (2, pytest.approx(0.1))]


def test_base_rate_restarts_at_the_start_date(spark):
    s = tape.sessions(quotes(spark, [10 + (i % 3) for i in range(45)]))
    r = tape.base_rate(s, start="2024-01-11").first()
    assert (r.n_sessions_a, r.n_sessions_b) == (35 - 19, 35 - 20)
    late = tape.trailing_z(s, "2024-01-25", "2024-12-31")
    assert late.where("z is not null").count() == late.count()


def test_anchor_is_strictly_before_and_drops_early_articles(spark):
    s = tape.sessions(quotes(spark, [10, 11, 12]))
    a = spark.createDataFrame([("x", "A", DAY + timedelta(1)), ("y", "A", DAY)], "id string, cod string, pub_date date")
    assert [(r.id, r.idx_before) for r in tape.anchor(a, s).collect()] == [("x", 1)]


def test_blocked_match_equals_nested_loop(spark):
    names = spark.createDataFrame([("1", "Eni"), ("2", "A2A"), ("3", "banca x"), ("4", "(odd)"), ("5", "St. Co")], "cod string, name string")
    titles = spark.createDataFrame([("a", "Eni sale"), ("b", "eni sale"), ("c", "Banca X e A2A"), ("d", "the (odd) one"), ("e", "Xeni"), ("f", "St. CO up"), ("g", "Enià")], "id string, title string")
    blocked = {(r.id, r.cod) for r in tape.match_names(titles, names).collect()}
    loop = titles.join(names.withColumn("p", tape.name_pattern("name")), F.expr("title rlike p"))
    assert blocked == {(r.id, r.cod) for r in loop.collect()}
    assert {("a", "1"), ("c", "2"), ("c", "3"), ("f", "5"), ("g", "1")} <= blocked and ("b", "1") not in blocked and ("e", "1") not in blocked


def test_names_that_share_a_word_meet_only_their_own_titles(spark):
    names = spark.range(1000).selectExpr("concat('C', id) AS cod", "concat('Banca ', id, ' SpA') AS name")
    titles = spark.range(3000).selectExpr("cast(id as string) AS id", "concat('La Banca ', id % 1500, '  SpA e Banca ', (id + 1) % 1500, ' SpA oggi') AS title")
    got = tape.match_names(titles, names)
    assert {(r.id, r.cod) for r in got.collect()} == {(str(i), f"C{(i + 1) % 1500}") for i in range(3000) if (i + 1) % 1500 < 1000}
    # every title meets one or two names, of which two spaces fail one
    assert tape.name_candidates(titles, names).count() <= 2 * 3000


def test_exact_seven_day_gap_is_a_first_article(spark):
    at = datetime(2024, 1, 1, 10)
    rows = [("1", "A", at), ("2", "A", at + timedelta(days=3)), ("3", "A", at + timedelta(days=10)), ("4", "A", at + timedelta(days=16))]
    a = spark.createDataFrame(rows, "id string, cod string, pub_utc timestamp")
    assert sorted(r.id for r in events.first_articles(a).collect()) == ["1", "3"]


def verdict(spark, rows):
    schema = "id string, cod string, phase string, pub_local timestamp, d date, timing string, z double, ret double, unusual boolean, is_reaction boolean, open_px double, open_share double, gap double, closed_before boolean, retained double"
    full = [("x", "A", r.get("phase", "in_session"), datetime(2024, 1, 2), DAY + timedelta(i), r.get("timing", "later"), r["z"], 0.01, None if r["z"] is None else abs(r["z"]) >= 2, r.get("reaction", False), 1.0, r.get("share"), 0.0, r.get("before", False), 0.0) for i, r in enumerate(rows)]
    return events.verdicts(spark.createDataFrame(full, schema)).first()


@pytest.mark.parametrize(
    "rows, status",
    [
        ([{"z": 1.0}, {"z": None}], "NO_REACTION"),
        ([{"z": 3.0, "before": True, "timing": "day_before"}, {"z": 2.5, "reaction": True}], "ALREADY_IN_PRICE"),
        ([{"z": 2.1, "before": True}, {"z": 2.5, "reaction": True}], "PARTLY_IN_PRICE"),
        ([{"z": 2.5, "reaction": True, "share": 0.6}], "MOSTLY_AT_OPEN"),
        ([{"z": 2.5, "reaction": True, "share": 0.5}], "REACTED"),
        ([{"z": 1.0, "reaction": True}, {"z": -2.5}], "DELAYED"),
        ([{"z": 2.5, "before": True}, {"z": -2.5}], "ALREADY_IN_PRICE"),
    ],
)
def test_statuses(spark, rows, status):
    assert verdict(spark, rows).status == status


def test_largest_remainder_sums_to_the_whole(spark):
    rows = spark.createDataFrame([(t, 1.0) for t in "abc"], "ticker string, value double")
    assert sorted((r.ticker, r.units) for r in desk.largest_remainder(rows).collect()) == [("a", 334), ("b", 333), ("c", 333)]


def test_carried_closes(spark):
    s = tape.sessions(quotes(spark, [10, 0, 12])).where("idx > 0")
    cal = spark.createDataFrame([(DAY + timedelta(i),) for i in range(-1, 3)], "d date")
    assert [r.close for r in desk.align(s, cal, lead=True).orderBy("d").collect()] == [10.0, 10.0, 10.0, 12.0]
    assert [r.close for r in desk.align(s, cal, lead=False).orderBy("d").collect()] == [None, 10.0, 10.0, 12.0]


def test_band_edges_start_the_next_band(spark):
    got = spark.createDataFrame([(x,) for x in (24.9, 25.0, 45.0, 55.0, 75.0)], "s double").select(sentiment.label(F.col("s")).alias("l")).collect()
    assert [r.l for r in got] == ["Extreme fear", "Fear", "Neutral", "Greed", "Extreme greed"]


def test_numbers_and_grounding(spark):
    row = spark.createDataFrame([("up 1.234,5 and 1,234.5 on 2024-01-02T09:30, +3,2% on 3 March 2024, −7 or 8–9 and 1.2.3", "1234.5 or 3.2")], "a string, b string")
    r = row.select(text.numbers("a").alias("n"), text.ungrounded_numbers("a", "b").alias("u")).first()
    assert r.n == [1234.5, 3.2, -7.0, 8.0, 9.0] and r.u == [-7.0, 8.0, 9.0]


RULES = [("capital", 1, "dividend", False, True), ("earnings", 2, "quarter", True, False), ("earnings", 3, "profit", False, False), ("market_report", 4, "rally", False, False)]


@pytest.fixture
def rules(spark):
    return spark.createDataFrame(RULES, "type string, rule_no int, pattern string, soft boolean, hard boolean")


@pytest.fixture
def priority(spark):
    return spark.createDataFrame([("earnings", 1), ("capital", 2), ("market_report", 3)], "type string, priority int")


def test_types_by_title_and_body(spark, rules, priority):
    rows = [("a", "Dividend after the QUARTER", ""), ("b", "Profit and dividend", ""), ("c", "Shares rally", "the rally came with a Dividend"), ("d", "nothing", "rally only"), ("e", "nothing", "x " * 400 + "profit"), ("f", None, None)]
    t = spark.createDataFrame(rows, "id string, title string, body string")
    titled = text.classify(t, rules, priority)
    assert {r.id: r.news_type for r in titled.collect()} == {"a": "capital", "b": "earnings", "c": "market_report", "d": "other", "e": "other", "f": "other"}
    final = text.with_body(titled, t.select("id", "body"), rules, priority)
    assert {r.id: r.news_type for r in final.collect()} == {"a": "capital", "b": "earnings", "c": "capital", "d": "other", "e": "other", "f": "other"}


def test_choice_of_type(spark, rules):
    titled = spark.createDataFrame([("a", "Profit", "earnings"), ("b", "Profit", "earnings"), ("c", "x", "earnings"), ("d", "chart talk", "market_report")], "id string, title string, news_type string")
    said = spark.createDataFrame([("a", 1, "capital", "no such word"), ("a", 2, "capital", "a Dividend"), ("b", 1, "other", "profit"), ("c", 1, "capital", "")], "id string, pos int, topic string, evidence string")
    got = {r.id: (r.final_type, r.reason) for r in text.choose_type(titled, said, rules, chart="chart talk").collect()}
    assert got == {"a": ("capital", "model_quote"), "b": ("earnings", "keyword_title"), "c": ("other", "unsupported"), "d": ("market_report", "keyword_title")}


def test_facts_are_kept_in_order_up_to_the_limit(spark):
    rows = [("g", i, q, "The profit was 12 and the debt 7.", k, s) for i, (q, k, s) in enumerate([("profit was 12", True, "12"), ("profit was 13", True, "12"), ("debt 7", False, "7"), ("debt 7", True, "8"), ("the debt 7", True, "buy at 7"), ("debt 7", True, "7"), ("12 and", True, "12"), ("nonsense", True, "1")])]
    x = text.verify_facts(spark.createDataFrame(rows, "g string, pos int, quote string, body string, known boolean, s string"), keys=["g"], known=F.col("known"), quote="quote", body="body", sentence="s", sources="body", vocabulary=["buy"])
    got = [(r.failure, r.kept) for r in x.orderBy("pos").collect()]
    assert got == [("", True), ("quote", False), ("unknown_id", False), ("numbers", False), ("words", False), ("", True), ("", True), (None, False)]


def test_headline_moves(spark):
    titles = {"Up (3,2%)": True, "margin up +3%": False, "shares −4%": True, "12% of the market": False, "It gains 3": True, "gains a stake": False}
    t = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    got = text.reports_move(t, moves=(r"gains [0-9a]",), deal="stake", deal_verb="gains", cue="share price").orderBy("id").collect()
    assert [r.reports_move for r in got] == list(titles.values())


def test_passages_meet_documents_on_runs_of_words(spark):
    q = spark.createDataFrame([(1, "a b c d e f"), (2, "too short")], "item_id int, quote string")
    d = spark.createDataFrame([(10, "x B  c D e f y"), (11, "a b c d"), (12, None)], "doc_id int, body string")
    assert [tuple(r) for r in text.shingle_pairs(q, d).collect()] == [(1, 10)]


@pytest.mark.parametrize("at, move", [("2024-01-03 10:00:00", 12 / 11 - 1), ("2024-01-03 18:00:00", 15 / 12 - 1), ("2024-01-05 10:00:00", 12 / 11 - 1), ("2024-01-05 18:00:00", 15 / 12 - 1), ("2024-01-01 10:00:00", None), ("2024-01-06 18:00:00", None)])
def test_reaction_to_results_on_any_day(spark, at, move):
    s = tape.sessions(quotes(spark, [10, 11, 12, 0, 0, 15]))  # no session on the fourth and fifth
    p = spark.createDataFrame([("x", "A", datetime.fromisoformat(at), datetime.fromisoformat(at).date())], "id string, cod string, pub_local timestamp_ntz, pub_date date")
    got = evidence.results_reaction(p, s).first().move
    assert got == (move if move is None else pytest.approx(move))


def test_top_k_forms_of_allocation(spark):
    rows = spark.createDataFrame([("a", 5.0), ("b", 4.0), ("c", 3.0), ("c", 0.5)], "ticker string, value double")
    assert {(r.ticker, r.value) for r in desk.bucketed(rows, "ticker", 1).collect()} == {("a", 5.0), ("other", 7.5)}
    assert {(r.ticker, r.value) for r in desk.bucketed(rows, "ticker", 1, most=3).collect()} == {("a", 5.0), ("b", 4.0), ("c", 3.5)}
    many = spark.range(3000).selectExpr("cast(id as string) ticker", "1.0D value")
    assert desk.largest_remainder(many).agg(F.sum("units")).first()[0] == 1000


def test_lists_differ_by_members_and_places(spark):
    lists = lambda codes: spark.createDataFrame([("s", c, i) for i, c in enumerate(codes)], "sector string, cod string, pos int")
    got = {(r.cod, r.change) for r in sentiment.membership_diff(lists("abd"), lists("bac")).collect()}
    assert got == {("a", "moved"), ("b", "moved"), ("c", "removed"), ("d", "added")}


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 100


def test_verdicts_scan_the_quotes_table_twice(spark, monkeypatch):
    """Once for the universe's codes and once for the quotes; everything after reads what was written."""
    import os

    from tidemark import fixtures
    from tidemark.operators import tape
    from tidemark.registry import queries
    from tidemark.sources import files

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    plans = []

    def counted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString())
        return files.written(df)

    monkeypatch.setattr(fixtures, "written", counted)
    monkeypatch.setattr(tape, "written", counted)
    for name in ("verdict_status", "news_rollup", "slot_lift"):
        plans.clear()
        plans.append(queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString())
        scans = [line for p in plans for line in p.splitlines() if "FileScan parquet" in line and "lineitem.parquet" in line]
        assert len(scans) == 2, name


def test_utc_peaks_and_local_tape_see_other_days(spark):
    """The event query takes the UTC date and always seven sessions; the tape takes the local date and at most five later ones."""
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(40)]
    quotes = spark.createDataFrame([("A", d, 100.0 + (i % 3) + (20 if i == 31 else 0), 100.0 + (i % 3), 0.0, 90.0, 200.0, 1.0) for i, d in enumerate(days)], "cod string, d date, last double, ref double, open double, low double, high double, qty double")
    names = spark.createDataFrame([("A", "Alpha", "IT1", "ORD")], "cod string, name string, isin string, kind string")
    # half past eleven at night of the 24th in UTC is the 25th in Rome
    articles = spark.createDataFrame([("x", "Alpha up", datetime(2024, 1, 24, 23, 30))], "id string, title string, pub_utc timestamp")
    local = tape.tape(articles, names, quotes).orderBy("d").collect()
    assert [r.d for r in local] == days[23:30] and [r.timing for r in local] == ["day_before", "same_day", *["later"] * 5]
    assert tape.event_peaks(articles, names, quotes).first().d in days[22:29]
    # on a day without a session the event query sees six later ones, the tape five
    gap = quotes.where(F.col("d") != days[24])
    late = tape.tape(articles, names, gap).orderBy("d").collect()
    assert [r.d for r in late] == [days[23], *days[25:30]] and {r.phase for r in late} == {"non_trading_day"}


def test_final_day_is_that_of_the_raw_table(spark):
    """A later row without a valid price makes the final day, on which retained moves are null."""
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(30)]
    rows = [("A", d, 100.0 + (i % 4), 100.0 + (i % 4), 0.0, 90.0, 200.0, 1.0) for i, d in enumerate(days)]
    names = spark.createDataFrame([("A", "Alpha", "IT1", "ORD")], "cod string, name string, isin string, kind string")
    articles = spark.createDataFrame([("x", "Alpha up", datetime(2024, 1, 24, 8, 0))], "id string, title string, pub_utc timestamp")
    schema = "cod string, d date, last double, ref double, open double, low double, high double, qty double"
    known = tape.tape(articles, names, spark.createDataFrame(rows, schema)).collect()
    assert {r.final_d for r in known} == {days[-1]} and all(r.final_px == 101.0 for r in known)
    later = [*rows, ("B", date(2024, 2, 9), 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)]
    null = tape.tape(articles, names, spark.createDataFrame(later, schema)).collect()
    assert {r.final_d for r in null} == {date(2024, 2, 9)} and all(r.final_px is None and r.retained is None for r in null)


def test_one_row_feeds_two_slots(spark):
    rows = [("a", "same_day", "in_session", True, True, None), ("b", "later", "after_close", True, False, 1), ("c", "day_before", "pre_open", False, True, None), ("d", "same_day", "after_close", False, False, None)]
    t = spark.createDataFrame(rows, "id string, timing string, phase string, is_reaction boolean, unusual boolean, later_rank int")
    rates = spark.createDataFrame([(0.1, 0.2)], "share_a double, share_b double")
    got = {r.slot: (r.n, r.n_unusual) for r in events.slot_lift(t, rates).collect()}
    assert got == {"reaction": (2, 1), "same_day_in_session": (1, 1), "later_1": (1, 0), "day_before": (1, 1), "same_day_after_close": (1, 0)}


def test_supports_by_type_alone(spark, rules):
    rows = [("earnings", "big Profit"), ("capital", "big profit"), ("other", "profit"), ("market_report", "chart talk"), ("nothing", "profit"), (None, "profit"), ("earnings", None), ("earnings", "")]
    got = [r.supports for r in text.supported(spark.createDataFrame(rows, "t string, s string"), rules, label="t", text="s", chart="chart talk").collect()]
    assert got == [True, False, False, True, False, False, False, False]


def test_sessions_of_a_span_are_those_of_a_loop(spark):
    """Spans that begin and end within blocks, run past both ends of the history or hold one session."""
    rows = tape.sessions(quotes(spark, [10 + i % 7 for i in range(150)]).unionByName(quotes(spark, [5 + i % 3 for i in range(3)], cod="B")))
    at = [(c, b) for c in "AB" for b in (1, 2, 15, 16, 31, 32, 33, 64, 100, 149, 150)]
    found = spark.createDataFrame([(f"{c}{b}", c, b) for c, b in at], "id string, cod string, idx_before int")
    for lo, hi in ((-25, 40), (0, 6), (0, 0)):
        got = sorted((r.id, r.idx) for r in tape.spread(found, rows, ["d"], F.col("idx_before") + lo, F.col("idx_before") + hi).collect())
        assert got == sorted((f"{c}{b}", i) for c, b in at for i in range(max(b + lo, 1), b + hi + 1) if i <= {"A": 150, "B": 3}[c])


def test_rows_of_tape_and_series_are_not_shuffled(spark):
    """Quotes and articles go to their instrument once; verdicts on what is spread from them need no further shuffle."""
    names = spark.createDataFrame([("A", "Alpha")], "cod string, name string")
    articles = spark.createDataFrame([("x", "Alpha up", datetime(2024, 1, 24, 8, 0))], "id string, title string, pub_utc timestamp")
    one = spark.createDataFrame([("x", "A")], "id string, cod string")
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], "-1")
        spark.conf.set(keys[1], "false")
        table = quotes(spark, [10 + i % 7 for i in range(60)])
        for df in (events.verdicts(tape.tape(articles, names, table, one=one)), tape.chart_series(articles, names, table, one=one).groupBy("cod", "id").count()):
            plan = df._jdf.queryExecution().executedPlan().toString()
            # both sides of the join by id, articles by instrument, the codes and the quotes, the latter two once each for statistics and for blocks
            assert plan.count("Exchange hashpartitioning") <= 7 and plan.count("hashpartitioning(id") == 2, plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_series_of_some_relative_numbers_keeps_each_first_session(spark):
    table = quotes(spark, [10 + i % 7 for i in range(60)])
    names = spark.createDataFrame([("A", "Alpha")], "cod string, name string")
    articles = spark.createDataFrame([("x", "Alpha up", datetime(2024, 2, 10, 8, 0)), ("y", "Alpha up", datetime(2024, 1, 5, 8, 0))], "id string, title string, pub_utc timestamp")
    one = spark.createDataFrame([("x", "A"), ("y", "A")], "id string, cod string")
    whole = {(r.id, r.rel, r.d, r.z) for r in tape.chart_series(articles, names, table, one=one).collect()}
    some = {(r.id, r.rel, r.d, r.z) for r in tape.chart_series(articles, names, table, one=one, rels=(-1, 0)).collect()}
    first = {i: min(r for k, r, *_ in whole if k == i) for i in "xy"}
    assert some == {w for w in whole if w[1] in (-1, 0, first[w[0]])} and len(some) == 6


def test_written_quotes_keep_instruments_and_days_in_order(spark):
    """Rows of one instrument lie together in every file, so that they take less room there and when they are shuffled again."""
    from tidemark.fixtures import Tables
    from tidemark.plans.tape import quotes_of

    t = Tables(spark, "/root/testdata/sf0.001")
    files = {}
    for r in quotes_of(t).select(F.input_file_name().alias("file"), "cod", "d").collect():
        files.setdefault(r.file, []).append((r.cod, r.d))
    assert sum(map(len, files.values())) == t.quotes.count() and all(rows == sorted(rows) for rows in files.values())


def test_sessions_that_an_article_takes_along_are_those_of_a_loop(spark):
    """Articles before, within and after blocks of sessions, and past the end of the history, in the tape's way and by hand."""
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(45)]
    rows = tape.sessions(quotes(spark, [10 + i % 7 for i in range(40)]).unionByName(quotes(spark, [5 + i % 3 for i in range(3)], cod="B")))
    articles = spark.createDataFrame([(f"{c}{i}", c, d) for c in "AB" for i, d in enumerate(days)], "id string, cod string, pub_date date")
    count = {"A": 40, "B": 3}
    for n, block in ((6, 8), (0, 1), (2, 1), (9, 3)):
        found = tape.anchor(articles, tape.ahead(rows, ["d"], n, block=block), latest=["_ahead"])
        got = sorted((r.id, r.idx, r.d) for r in tape.onward(found, n).collect())
        before = {(c, i): min(i, count[c]) for c in "AB" for i in range(1, len(days))}  # article i is of day i + 1
        assert got == sorted((f"{c}{i}", j, days[j - 1]) for (c, i), b in before.items() for j in range(b, b + n + 1) if j <= count[c]), (n, block)


@pytest.mark.parametrize("name", ["company_summary", "integrity_checks", "facts_top4", "company_index_sorted", "news_rollup", "news_by_indicator", "tape_window", "thesis_title_match"])
def test_quotes_are_summed_once_and_not_written(spark, monkeypatch, name):
    """The tape takes quotes from the table in one pass: no plan writes them and only one sums them."""
    from tidemark import fixtures
    from tidemark.registry import queries
    from tidemark.sources import files

    plans, columns = [], []

    def counted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        columns.append(set(df.columns))
        return files.written(df)

    monkeypatch.setattr(fixtures, "written", counted)
    monkeypatch.setattr(tape, "written", counted)
    plans.append(queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString())
    scans = [line for p in plans for line in p.splitlines() if "FileScan parquet" in line and "lineitem.parquet" in line and "l_extendedprice" in line]
    assert len(scans) == 1 and not any({"last", "ref", "open"} <= c for c in columns)
