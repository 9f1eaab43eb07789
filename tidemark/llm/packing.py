"""Best-fit packing under conflicts: residual-ordered bins carry source and duplicate-cluster bitmaps.

Documents longer than a bin are cut into full bins and a rest. Pieces are dealt by hash into shards of bounded size, so
hot sources and clusters spread evenly, or by ranges of a given order of the documents, so that a mix holds; inside a shard, pieces come longest first, and each goes to the open bin
with the smallest sufficient residual whose bitmaps hold neither its source (beyond `per_source` pieces) nor its cluster,
found by successor search from its length upwards. No piece is dropped: one that fits nowhere opens a bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import n_words, runs, words


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, in the given order. sources and clusters are small codes, -1 for none.

    Of bins equally tight the first opened is taken; a piece of the whole capacity has a bin of its own, one of no words
    goes into the fullest compatible bin that is not full; no pieces give no bins.
    """
    open_: list[tuple[int, int]] = []  # (residual, bin), sorted
    source_map: list[list[int]] = []  # per bin: bitmaps of sources seen once, twice, ...
    cluster_map: list[int] = []
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(open_, (size, -1))
        while at < len(open_) and (source_map[open_[at][1]][-1] & s or cluster_map[open_[at][1]] & c):
            at += 1
        if at < len(open_):
            residual, b = open_.pop(at)
        else:
            residual, b = capacity, len(source_map)
            source_map.append([0] * per_source)
            cluster_map.append(0)
        level = next(i for i in range(per_source) if not source_map[b][i] & s) if s else 0
        source_map[b][level] |= s
        cluster_map[b] |= c
        bins.append(b)
        offsets.append(capacity - residual)
        if residual > size:
            insort(open_, (residual - size, b))
    return bins, offsets


def pack(docs: DataFrame, *, text: str = "text", id: str = "doc_id", source: str = "source", cluster: str | None = None, capacity: int = 2048, per_source: int = 4, shard: int = 4096, position: str | None = None) -> DataFrame:
    """(doc_id, piece, start, n_words, shard, bin, bin_start): where each piece of each document's words goes.

    Two pieces of one cluster never share a bin, nor do more than `per_source` pieces of one source. Without a `cluster`
    column the cluster is the hash of the words, so equal texts are kept apart. A null source or a null cluster conflicts
    with nothing; a null or wordless text has one piece of no words, which is packed like any other. Repeated rows are
    pieces of their own. Bins are numbered within a shard: a bin's name is (shard, bin). An empty table gives an empty table.
    With `position`, a column of numbers from 0, shard i holds the documents from i `shard` on, and shards follow that order.
    """
    group = F.col(cluster).cast("string") if cluster else F.xxhash64(words(text)).cast("string")
    at = F.col(position).cast("long") if position else F.lit(None).cast("long")
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), group.alias("cluster"), n_words(text).alias("n"), at.alias("at"))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int"))))
    start = F.col("piece").cast("long") * capacity
    pieces = pieces.withColumn("start", start).withColumn("n_words", F.least(F.col("n") - start, F.lit(capacity)).cast("int"))
    if position:
        pieces = pieces.withColumn("shard", F.floor(F.col("at") / shard))
    else:
        # rows without an id are told apart by their place in the input, so that equal ones do not share one shard
        spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
        pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster", spread), F.lit(max(1, docs.count() // shard))))
    slim = pieces.select("shard", F.col("n_words"), "doc_id", "piece", "start", "source", "cluster")
    dealt = slim.repartition("shard").sortWithinPartitions("shard", F.desc("n_words"), "doc_id", "piece", "start")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, x in runs(batches, "shard"):
            bins, offsets = best_fit(x["n_words"].tolist(), pd.factorize(x["source"])[0].tolist(), pd.factorize(x["cluster"])[0].tolist(), capacity, per_source)
            yield x.assign(bin=bins, bin_start=offsets)[["doc_id", "piece", "start", "n_words", "source", "cluster", "shard", "bin", "bin_start"]]

    return dealt.mapInPandas(fill, "doc_id long, piece int, start long, n_words int, source string, cluster string, shard long, bin int, bin_start int")


def op4(docs: DataFrame) -> DataFrame:
    """The query's table: `pack` with its defaults, whose docstring states the edge cases."""
    return pack(docs)
