"""Queries against their SQL twins on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tidemark.registry import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: One or two of each family; the driver compares all of them.
NAMES = ["base_rate", "tape_window", "verdicts", "slot_lift", "first_article_7d", "sector_day", "composite_index", "pole_vectors", "news_type_priority", "news_rollup", "results_articles_top2", "largest_remainder_weights", "calendar_align", "card_overlay", "stream_first_article", "stream_daily_shock_counts",
    "results_reaction", "since_last_results", "price_vs_thesis", "body_fallback", "choose_type", "extract_numbers", "fact_verification", "classification_validation", "membership_diff", "status_shares",
    "portfolio_value_series", "upsert_news_block", "json_card_scan", "integrity_checks", "series_card_reconcile", "quarter_entry_join", "quarter_metric_pivot", "decision_verification", "recalc_diff", "candidate_top30", "classifier_distribution", "news_by_indicator", "headline_reports_move"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, duck, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.execute(oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted(names) == cols and got == want and got
