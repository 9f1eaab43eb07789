"""CSV and JSON tables, and documents that may be JSON objects or plain text."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scratch(df: DataFrame) -> str:
    """A new path in the folder that driver and executors share; a local folder only for a local master without the setting."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{shared.rstrip('/')}/files/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: what several branches of a plan read is worked out once, and a lost executor costs a re-read."""
    path = scratch(df)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def roundtrip_csv(df: DataFrame) -> DataFrame:
    """Write with a header and read back with the schema: blanks are nulls, text is typed again."""
    path = scratch(df)
    df.write.option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def roundtrip_json(df: DataFrame, *partitions: str) -> DataFrame:
    """Write one JSON object for each row, in folders by `partitions`, and read back with the schema."""
    path = scratch(df)
    writer = df.write.partitionBy(*partitions) if partitions else df.write
    writer.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def parse_document(df: DataFrame, raw: str) -> DataFrame:
    """df plus title and body: fields of a JSON object under their aliases, else the raw text as the body."""
    x = F.from_json(raw, "title string, headline string, text string, content string, body string")
    return df.withColumn("_j", F.when(F.ltrim(raw).startswith("{"), x)).withColumns({
        "title": F.coalesce("_j.title", "_j.headline"), "body": F.coalesce("_j.body", "_j.text", "_j.content", raw),
    }).drop("_j")
