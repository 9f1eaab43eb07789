"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, linededup, mixing, packing, quality
from tidemark.llm.common import n_words, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.judge(docs).where("kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document left without a word goes too."""
    out = linededup.dedup_lines(docs)
    return out.where((F.col("n_lines_removed") == 0) | (n_words("text") > 0)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingle similarity, the one of the smallest id stays."""
    return jaccard.one_of_each(docs).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: DataFrame | None = None) -> DataFrame:
    """Every document stays; the files hold them in the order of the mix, which packing reads."""
    mixed = mixing.schedule(docs, weights)
    return mixed.orderBy(F.col("slot").asc_nulls_last(), "place", "doc_id").select(docs.columns)


def packing_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; shards are ranges of the mix, the order in the files of docs."""
    return packing.pack(mixing.in_file_order(docs), position="position")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("packing", packing_bins),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, weights: DataFrame | None = None) -> DataFrame:
    """The last stage's rows. weights has (source, weight) for the mix; without it, square roots of the row counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir, weights) if name == "mix_sources" else stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
