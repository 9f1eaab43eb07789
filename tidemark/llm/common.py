"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word: space and the five control characters from tab to carriage return.
SPACES = " \t\n\x0b\f\r"
SPLIT = "[\\x20\\x09-\\x0D]+"


#: Folders of intermediate tables that this process wrote, for `release`.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only for a local master without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and gives Spark the true size."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    (_WRITTEN if paths is None else paths).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete the given intermediate tables, or all that this process wrote; only once nothing lazy reads them any more."""
    paths = _WRITTEN if paths is None else paths
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def boxed(docs: DataFrame, *more: Column) -> DataFrame:
    """Rows as one struct `row`, so that no column of theirs clashes with a working column, plus `more`."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def unboxed(out: DataFrame, columns: list[str], *added: str, **replaced: Column) -> DataFrame:
    """The struct's columns again (`replaced` ones anew), then the added columns, which take the place of any of their name."""
    kept = [replaced.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns if c not in added]
    return out.select(*kept, *added)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, an empty array for null or blank."""
    trimmed = F.btrim(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def n_words(text: str) -> Column:
    return F.size(words(text)).cast("long")


def text_words(text: str | None) -> list[bytes]:
    """The words of a whole text with A-Z lower-cased (bytes methods touch ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[dict[str, list]]:
    """The columns of a few rows at a time as Python lists, so that no whole batch of texts stands twice in memory."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows).to_pydict()


def runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[object, pd.DataFrame]]:
    """Groups of equal key out of a partition that is sorted by it; a group may span batches."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        at = [0, *((batch[key].to_numpy()[1:] != batch[key].to_numpy()[:-1]).nonzero()[0] + 1), len(batch)]
        for a, b in zip(at, at[1:], strict=False):
            part = batch.iloc[a:b]
            if kept and kept[0][key].iloc[0] != part[key].iloc[0]:
                yield kept[0][key].iloc[0], pd.concat(kept) if len(kept) > 1 else kept[0]
                kept = []
            kept.append(part)
    if kept:
        yield kept[0][key].iloc[0], pd.concat(kept) if len(kept) > 1 else kept[0]
