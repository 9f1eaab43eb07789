"""Value series, alignment, card folders, bundles and document scans, by hand-made cases."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import desk as op
from tidemark.sources import cards as cd


def day(i):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=i)


@pytest.fixture(scope="module")
def market(spark):
    rng = random.Random(2)
    closes = {f"S{c}": {i: round(rng.uniform(1, 99), 2) for i in sorted(rng.sample(range(c, 60), 20 + c))} for c in range(8)}
    closes["ONCE"] = {59: 7.0}
    rows = [(c, day(i), v) for c, x in closes.items() for i, v in x.items()]
    return closes, spark.createDataFrame(rows, "cod string, d date, last double")


def grid(closes, c, lead=True):
    """Closes of a code on all days of the calendar."""
    days = sorted({i for x in closes.values() for i in x})
    out, last = {}, closes[c][min(closes[c])] if lead else None
    for i in days:
        last = closes[c].get(i, last)
        out[i] = last
    return out


@pytest.mark.parametrize("lead", [True, False])
def test_alignment_by_intervals(market, lead):
    closes, sessions = market
    got = {(r.cod, r.d): r.close for r in op.align(sessions, sessions.select("d"), lead=lead).collect()}
    assert got == {(c, day(i)): v for c in closes for i, v in grid(closes, c, lead).items()}


def test_value_series_is_the_sum_of_aligned_closes(spark, market):
    closes, sessions = market
    held = {"S1": 10.0, "S3": 2.5, "ONCE": 100.0, "NONE": 3.0}
    got = op.value_series(spark.createDataFrame(list(held.items()), "ticker string, qty double"), sessions, {"1M": 21, "ALL": None, "1D": 1})
    want = {}
    for c, q in held.items():
        for i, v in (grid(closes, c) if c in closes else {}).items():
            want[day(i)] = want.get(day(i), 0) + q * v
    days = sorted(want)
    rows = got.collect()
    assert {r.d: round(float(r.value), 6) for r in rows if r.range == "ALL"} == {d: round(v, 6) for d, v in want.items()}
    assert sorted(r.d for r in rows if r.range == "1M") == days[-21:] and [r.d for r in rows if r.range == "1D"] == days[-1:]
    (r,) = {(round(float(r.change), 6), round(r.pct, 6)) for r in rows if r.range == "1M"}
    a, z = want[days[-21]], want[days[-1]]
    assert r == (round(z - a, 6), round((z / a - 1) * 100, 6))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in got._jdf.queryExecution().executedPlan().toString() and plan.count("Join Cross") <= 2  # with rows of one


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_upsert_touches_only_buckets_that_change(spark, tmp_path):
    cards = spark.createDataFrame([(f"i{i}", "x", ("old", None)) for i in range(200)], "id string, cod string, news struct<news_type:string,confidence:double>")
    folders = [f"{tmp_path}/a", f"{tmp_path}/b"]
    for f in folders:
        cd.write_bucketed(cards, f"{f}/cards")
        cd.write_bucketed(cards.select("id", "cod", "news.*"), f"{f}/index")
    updates = spark.createDataFrame([("i3", ("new", 0.5)), ("i4", ("old", None)), ("gone", ("new", 1.0))], "id string, news struct<news_type:string,confidence:double>")
    before = files_of(tmp_path)
    done = cd.upsert_blocks(spark, folders, updates, index_fields=["news_type", "confidence"])
    assert set(done.values()) == {1} and len(done) == 4
    after = files_of(tmp_path)
    kept = [f for f in before if after.get(f) == before[f]]
    bucket = spark.range(1).select(cd.bucket_of(F.lit("i3"), 16).alias("b")).first().b
    assert {f"{bucket}" in f.split("bucket=")[1].split("/")[0] for f in set(before) - set(kept)} == {True} and len(kept) == len(before) - 4
    for f in folders:
        x = {r.id: (r.cod, tuple(r.news)) for r in cd.read_bucketed(spark, f"{f}/cards").collect()}
        assert len(x) == 200 and x["i3"] == ("x", ("new", 0.5)) and x["i4"] == ("x", ("old", None))
        assert {r.id: r.news_type for r in cd.read_bucketed(spark, f"{f}/index").collect()}["i3"] == "new"
    assert set(cd.upsert_blocks(spark, folders, updates, index_fields=["news_type", "confidence"]).values()) == {0} and files_of(tmp_path) == after


def test_documents_over_lines_corrupt_ones_and_the_index(spark, tmp_path):
    docs = {"a.json": json.dumps({"id": "a", "card": {"n": 1}, "more": [1]}, indent=2), "b.json": '{"id": "b", "card": {"n": "x"}}', "c.json": "{ not json", "index.json": '{"cards": []}', "note.txt": "{}", "d.json": ""}
    os.mkdir(tmp_path / "sub")
    for name, text in docs.items():
        (tmp_path / ("sub" if name == "a.json" else ".") / name).write_text(text)
    good, bad = cd.scan_documents(spark, str(tmp_path), "id string, card struct<n:int>")
    assert [(r.file, r.id, r.card.n) for r in good.collect()] == [("a.json", "a", 1)]
    assert {r.file: r.raw for r in bad.collect()} == {n: docs[n] for n in ("b.json", "c.json")}  # an empty file is not read
    out = f"{tmp_path}/out"
    cd.write_documents(spark.createDataFrame([("x.json", docs["a.json"]), ("index.json", "{}")], "file string, text string"), out)
    assert [(r.file, r.id) for r in cd.scan_documents(spark, out, "id string, card struct<n:int>")[0].collect()] == [("x.json", "a")]


def test_documents_are_packed_and_files_do_not_grow_with_them(spark, tmp_path):
    docs = spark.range(2000).selectExpr("concat('S', id, '.json') AS file", "concat('{\n\"id\": \"', id, if(id % 5 = 4, '\"', '\"}')) AS text").coalesce(2)
    out = f"{tmp_path}/out"
    cd.write_documents(docs, out)
    (tmp_path / "out" / "own.json").write_text('{"id":\n"own"}')  # a file of its own beside them
    assert sum(len(fs) for _, _, fs in os.walk(out)) < 20
    good, bad = cd.scan_documents(spark, out, "id string")
    assert {r.file: r.id for r in good.collect()} == {f"S{i}.json": str(i) for i in range(2000) if i % 5 != 4} | {"own.json": "own"}
    assert {r.file for r in bad.collect()} == {f"S{i}.json" for i in range(2000) if i % 5 == 4}


def test_bundle_and_columns(spark, tmp_path):
    cards = spark.createDataFrame([(f"i{i}", "c", i, [1.0 * i]) for i in range(40)], "id string, cod string, n int, z array<double>")
    cd.write_bundle(cards, f"{tmp_path}/b", index_fields=["cod", "n"])
    assert {r.id: r.n for r in spark.read.json(f"{tmp_path}/b/index").collect()} == {r.id: r.z[0] for r in spark.read.json(f"{tmp_path}/b/cards").collect()}
    days = spark.createDataFrame([("A", day(2), 1.00005, 3.4, None, None), ("A", day(1), 2.0, 5.0, 0.12345, -1.005)], "cod string, d date, last double, qty double, ret double, z double")
    (r,) = op.company_columns(days).collect()
    assert (r.d, r.close, r.volume, r.move_pct, r.z) == (["2024-01-02", "2024-01-03"], [2.0, 1.0001], [5.0, 3.0], [12.35, None], [-1.01, None])
