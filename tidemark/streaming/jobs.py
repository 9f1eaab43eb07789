"""Structured Streaming forms of two batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_article_sessions(stream: DataFrame, *, key: str, at: str, days: int = 7, late: str = "7 days") -> DataFrame:
    """First event of each run of events less than `days` apart, by key. The gap is a microsecond short, so that an exact gap starts anew."""
    gap = f"{days * 86400 * 1_000_000 - 1} microseconds"
    return stream.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("run")).agg(F.min(at).alias("first_at"), F.count(F.lit(1)).alias("n")).select(key, "first_at", "n")


def daily_counts(stream: DataFrame, *, key: str, at: str, value: str, cut: float, late: str = "1 day") -> DataFrame:
    """Events and large ones by key and day."""
    w = F.window(at, "1 day")
    return stream.withWatermark(at, late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(value) >= cut).alias("large")).select(key, F.to_date("w.start").alias("d"), "n", "large")


def run_available(out: DataFrame) -> DataFrame:
    """Drain what the source holds now into Parquet files of the shared folder, in append mode, and read them back.

    Append mode gives a group once the watermark has passed it, so state stays bounded and no row goes through the driver;
    groups that the watermark has not passed yet stay in the checkpoint for the next run.
    """
    from tidemark.sources.files import scratch

    path = scratch(out)
    q = out.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{path}/rows")


def count_baseline(days: DataFrame, *, key: str, value: str) -> DataFrame:
    """(key, base_n, base_mean, base_sd) of a value of closed days, from the batch side: a row for each key."""
    return days.groupBy(key).agg(F.count(value).alias("base_n"), F.avg(value).alias("base_mean"), F.stddev_samp(value).alias("base_sd"))


def scored(days: DataFrame, baseline: DataFrame, *, key: str, value: str, least: int = 2) -> DataFrame:
    """days plus z of their value against the key's baseline; null without `least` baseline days or any spread."""
    z = F.when(F.col("base_n") >= least, F.try_divide(F.col(value) - F.col("base_mean"), F.nullif("base_sd", F.lit(0.0))))
    return days.join(baseline, key, "left").withColumn("z", z).drop("base_n", "base_mean", "base_sd")


def run_scored(days: DataFrame, baseline: DataFrame, path: str, *, key: str, value: str) -> DataFrame:
    """Drain what the source holds now: each micro-batch of closed days is scored against the static baseline and written to a folder of its batch id.

    A batch that runs again, as after a failure between its write and its commit, overwrites its own folder, so no day
    is written twice. The baseline is written once, so that every batch meets the same.
    """
    baseline.write.mode("overwrite").parquet(f"{path}/baseline")
    static = days.sparkSession.read.schema(baseline.schema).parquet(f"{path}/baseline")

    def put(batch: DataFrame, batch_id: int) -> None:
        scored(batch, static, key=key, value=value).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    q = days.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = scored(days, static, key=key, value=value).schema
    return days.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/rows")
