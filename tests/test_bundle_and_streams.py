"""Bundle integrity, reconciliation of series and cards, and scored streams, by hand-made cases."""

import collections
import datetime
import os
import shutil


from tidemark.operators import desk, events
from tidemark.streaming import jobs

STATUSES = ["NO_REACTION", "REACTED"]
NAN, INF = float("nan"), float("inf")


def test_every_fault_of_a_bundle_is_found(spark):
    stories = [
        ("ok", "A", "REACTED", True, 1.0), ("quiet", "A", "NO_REACTION", False, None), ("twice", "A", "REACTED", True, 1.0), ("twice", "A", "REACTED", True, 1.0), ("lost", "A", "REACTED", True, 0.0), ("nowhere", "Z", "REACTED", True, 0.0),
        ("odd", "A", "ODD", True, 0.0), ("none", "A", None, True, 0.0), ("flag", "A", "REACTED", False, 0.0), ("nan", "A", "REACTED", True, NAN), ("inf", "A", "REACTED", True, 0.0), ("empty", "A", "REACTED", True, 0.0),
    ]
    details = [(i, "NO_REACTION" if i == "quiet" else "REACTED", None if i == "quiet" else [] if i == "empty" else [1.0, -INF if i == "inf" else 2.0]) for i in ("ok", "quiet", "twice", "nowhere", "odd", "none", "flag", "nan", "inf", "empty", "extra", "copy", "copy")]
    price = (["d"], [1.0])
    companies = [
        ("A", 11, {"REACTED": 10, "NO_REACTION": 1}, True, price), ("B", 1, {"REACTED": 0, "ODD": 1}, False, price), ("C", 0, {"REACTED": 1}, True, (["d", "e"], [NAN])), ("D", 0, {}, False, None), ("E", 0, {}, True, None),
    ]
    frames = (
        spark.createDataFrame(stories, "id string, cod string, status string, has_series boolean, z double"), spark.createDataFrame(details, "id string, status string, series array<double>"),
        spark.createDataFrame(companies, "cod string, n_stories int, counts map<string,int>, has_prices boolean, prices struct<d:array<string>,close:array<double>>"),
    )
    found = collections.defaultdict(set)
    for r in desk.integrity(*frames, STATUSES, {"stories": 12, "companies": 4}).collect():
        found[r.rule].add(r.id)
    assert found == {
        "duplicate_story": {"twice"}, "duplicate_detail": {"copy"}, "story_without_detail": {"lost"}, "detail_without_story": {"extra", "copy"}, "story_without_company": {"nowhere"}, "unknown_status": {"odd", "none"}, "status_differs": {"odd", "none"},
        "series_flag": {"flag"}, "series_empty": {"empty"}, "not_finite": {"nan", "inf", "C"}, "company_count": {"B"}, "company_summary": {"C"}, "unknown_summary_status": {"B"}, "price_flag": {"B", "E"}, "array_lengths": {"C"}, "manifest_count": {"companies"},
    }
    clean = [f.where("false") for f in frames]
    assert desk.integrity(*clean, STATUSES, {"stories": 0}).count() == 0


def test_series_and_cards_are_reconciled_by_day(spark):
    d = lambda i: datetime.date(2024, 1, i)
    series = spark.createDataFrame([("a", -1, d(1), 0.123), ("a", 0, d(2), 2.5), ("a", 1, d(3), 9.0), ("b", -1, d(1), 1.0), ("b", 0, d(2), 3.0), ("only", 0, d(2), 1.0)], "id string, rel int, d date, z double")
    session = "struct<d:date,z:double>"
    cards = spark.createDataFrame([("a", (d(2), 2.5000001), (d(2), 2.5000001), [(d(2), 2.5)]), ("b", None, (d(2), 4.0), []), ("c", None, None, [])], f"id string, largest {session}, peak {session}, sessions array<{session}>")
    got = {(r.id, r.rel): (r.d, r.state) for r in events.reconcile(series, cards, events.card_dates(cards)).collect()}
    assert got == {
        ("a", -1): (d(1), "n/a"), ("a", 0): (d(2), "OK"), ("b", -1): (d(1), "n/a"), ("b", 0): (d(2), "MISMATCH"), ("c", -1): (None, "series_missing"), ("c", 0): (None, "series_missing"), ("only", -1): (None, "no_card"), ("only", 0): (d(2), "no_card"),
    }


def test_a_batch_that_runs_again_writes_nothing_twice(spark, tmp_path):
    at = lambda i, h: datetime.datetime(2024, 1, i, h)
    first = [("k", at(i, h), 1.0 * i) for i in (1, 2, 3) for h in (1, 5)]
    schema = "key string, at timestamp, value double"
    source = f"{tmp_path}/in"
    base = spark.createDataFrame([("k", 1), ("k", 3), ("once", 5)], "key string, large long")
    baseline = jobs.count_baseline(base, key="key", value="large")

    def run():
        days = jobs.daily_counts(spark.readStream.schema(schema).parquet(source), key="key", at="at", value="value", cut=2.0, late="1 hour")
        return {(r.key, r.d.day): (r.n, r.large, r.z and round(r.z, 4)) for r in jobs.run_scored(days, baseline, f"{tmp_path}/out", key="key", value="large").collect()}

    spark.createDataFrame(first, schema).coalesce(1).write.parquet(source)
    day = {("k", 1): (2, 0, round(-2 / 2**0.5, 4)), ("k", 2): (2, 2, 0.0)}
    assert run() == day and run() == day
    # the last batch has written but not been committed: it runs again under its number
    commits = sorted((f for f in os.listdir(f"{tmp_path}/out/state/commits") if f.isdigit()), key=int)
    for f in (commits[-1], f".{commits[-1]}.crc"):
        if os.path.exists(p := f"{tmp_path}/out/state/commits/{f}"):
            os.remove(p)
    assert run() == day
    spark.createDataFrame([("new", at(9, 1), 5.0), ("k", at(9, 2), 5.0), ("k", at(1, 1), 5.0)], schema).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([("k", at(20, 1), 5.0)], schema).coalesce(1).write.mode("append").parquet(source)
    got = run()
    assert got == day | {("k", 3): (2, 2, 0.0), ("k", 9): (1, 1, round(-1 / 2**0.5, 4)), ("new", 9): (1, 1, None)}  # the late event of day 1 is left out
    shutil.rmtree(f"{tmp_path}/out")


def test_scores_need_a_spread(spark):
    days = spark.createDataFrame([("a", 3), ("b", 3), ("c", 3)], "key string, n long")
    base = jobs.count_baseline(spark.createDataFrame([("a", 1), ("a", 1), ("b", 4)], "key string, n long"), key="key", value="n")
    assert [r.z for r in jobs.scored(days, base, key="key", value="n").orderBy("key").collect()] == [None, None, None]
