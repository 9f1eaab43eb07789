"""Streaming queries against their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.fixtures import Tables
from tidemark.registry import query
from tidemark.streaming import jobs


def events(t: Tables):
    schema = t.base("events").schema
    s = t.spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", True).parquet(t.sf_dir)
    return s.withColumn("at", F.col("ts").cast("timestamp"))


#: Groups that the watermark, a day behind the latest event, has passed: the others are still open.
PASSED = "<= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"


@query("stream_first_article", "", f"""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 DAY THEN 1 ELSE 0 END AS s FROM events)) GROUP BY user_id, run HAVING max(ts) + INTERVAL 1 DAY {PASSED}""")
def _(t):
    x = jobs.run_available(jobs.first_article_sessions(events(t), key="user_id", at="at", days=1, late="1 day"))
    return x.select("user_id", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"), "n")


#: The baseline is made of the days before this one.
BASE_UNTIL = "2024-01-21"


@query("stream_daily_shock_counts", "", f"""WITH days AS (SELECT event_type, cast(ts as date) AS d, count(*) AS n, count(*) FILTER (abs(value) >= 50) AS large FROM events GROUP BY event_type, cast(ts as date)),
  base AS (SELECT event_type, avg(large) AS m, stddev_samp(large) AS s FROM days WHERE d < date '{BASE_UNTIL}' GROUP BY event_type HAVING count(*) >= 2)
  SELECT event_type, d, n, large, round((large - m) / nullif(s, 0), 6) AS z FROM days LEFT JOIN base USING (event_type) WHERE d + INTERVAL 1 DAY {PASSED}""")
def _(t):
    from tidemark.sources.files import scratch

    e = t.base("events")
    history = e.where(F.col("ts") < F.to_date(F.lit(BASE_UNTIL))).groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count_if(F.abs("value") >= 50).alias("large"))
    days = jobs.daily_counts(events(t), key="event_type", at="at", value="value", cut=50.0, late="1 day")
    out = jobs.run_scored(days, jobs.count_baseline(history, key="event_type", value="large"), scratch(e), key="event_type", value="large")
    return out.select("event_type", "d", "n", "large", F.round("z", 6).alias("z"))
