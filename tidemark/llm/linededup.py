"""Line dedup: ranks of line sequences by distributed prefix doubling, later copies of repeated runs deleted.

A document is its sequence of lines with a word. Round 0 gives every line that occurs more than once a rank; round k
joins the ranks of the 2^k lines from a position with those of the 2^k lines after them, so positions with equal rank
are one interval of the suffix array whose longest common prefix is at least 2^(k+1) lines. Positions alone in their
interval leave at once, so that each round handles only what repeats. A maximal repeated run of at least `min_words`
words is the union of its shortest windows of `min_words` words from a line on and up to a line; each such window is
named by two overlapping ranks, its interval keeps the first position, and every later one is deleted. As each line
has a word, no window is longer than `min_words` lines, which bounds the rounds by log2(min_words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, boxed, n_words, release, unboxed, written

KEY = ["id", "th"]


def line_table(docs: DataFrame, text: str) -> DataFrame:
    """One row for each line with a word: document key, line number, ordinal among such lines, hashes, words."""
    rows = docs.select("id", "th", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line", "s"))
    rows = rows.where(F.length(F.translate("s", SPACES, "")) > 0)
    return rows.select("id", "th", "line", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(7), "s").alias("h2"), n_words("s").alias("w"), F.monotonically_increasing_id().alias("pos"))


def _windows(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Shortest windows of enough words from each line on and up to each line, inside one segment of repeated lines."""

    def solve(x: pd.DataFrame) -> pd.DataFrame:
        seg = x[["id", "th", "seg"]].to_numpy()
        new = np.r_[True, (seg[1:] != seg[:-1]).any(axis=1)]
        start = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
        end = np.r_[np.flatnonzero(new)[1:], len(x)][np.cumsum(new) - 1]
        total = np.r_[0, np.cumsum(x["w"].to_numpy())]
        i = np.arange(len(x))
        stop = np.searchsorted(total, total[:-1] + least)  # first position with enough words from i on
        on = stop <= end
        first = np.searchsorted(total, total[1:] - least, side="right") - 1
        upto = (total[1:] >= least) & (first >= start)
        pair = np.unique(np.r_[np.c_[i[on], stop[on]], np.c_[first[upto], i[upto] + 1]].reshape(-1, 2), axis=0)
        a, b = pair[:, 0], pair[:, 1]
        out = x.iloc[a][["id", "th", "o", "line"]].reset_index(drop=True)
        return out.assign(m=(b - a).astype("int32"), last=x["line"].to_numpy()[b - 1])

    rest = None
    for batch in batches:
        x = batch if rest is None else pd.concat([rest, batch])
        if not len(x):
            continue
        tail = (x["id"].to_numpy() == x["id"].iloc[-1]) & (x["th"].to_numpy() == x["th"].iloc[-1])
        rest = x[tail]
        if not tail.all():
            yield solve(x[~tail])
    if rest is not None and len(rest):
        yield solve(rest)


def deletions(docs: DataFrame, text: str = "text", *, min_words: int = 50, paths: list[str] | None = None) -> DataFrame:
    """(id, th, ranges): line ranges to delete in each document that holds a later copy. docs has id, th and the text."""
    lines = written(line_table(docs, text), paths)
    twice = lines.groupBy("h1", "h2").agg(F.min("pos").alias("rank"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # a row given twice has the same document key and counts once
    some = lines.join(twice, ["h1", "h2"]).select("id", "th", "line", "w", "pos", "rank").dropDuplicates(["id", "th", "line"])
    # ordinals skip blank lines; a segment is a stretch of lines that all occur elsewhere
    order = lines.join(some.select("id", "th").distinct(), KEY, "left_semi").dropDuplicates(["id", "th", "line"])
    order = order.select("id", "th", "line", F.row_number().over(Window.partitionBy(*KEY).orderBy("line")).alias("o"))
    some = some.join(order, ["id", "th", "line"])
    by = Window.partitionBy(*KEY)
    some = some.withColumn("seg", F.col("o") - F.row_number().over(by.orderBy("o")))
    some = some.withColumn("sw", F.sum("w").over(Window.partitionBy(*KEY, "seg"))).where(F.col("sw") >= min_words).drop("sw")
    some = written(some, paths)
    schema = "id long, th long, o int, line int, m int, last int"
    windows = some.select("id", "th", "o", "line", "w", "seg").repartition(*KEY).sortWithinPartitions("id", "th", "o")
    windows = written(windows.mapInPandas(lambda it: _windows(it, min_words), schema), paths)
    # log(2, x) is inexact at powers of two
    level = F.length(F.conv(F.col("m").cast("string"), 10, 2)) - 1
    windows = windows.withColumn("k", level)
    top = windows.agg(F.max("k")).first()[0]
    ranks = some.select("id", "th", "o", "pos", "rank")
    levels = ranks.withColumn("k", F.lit(0))
    for k in range(top or 0):
        ahead = F.min("rank").over(by.orderBy("o").rangeBetween(1 << k, 1 << k))
        pairs = ranks.withColumn("next", ahead).where("next is not null")
        cells = pairs.groupBy("rank", "next").agg(F.min("pos").alias("new"), F.count(F.lit(1)).alias("n")).where("n > 1")
        ranks = written(pairs.join(cells, ["rank", "next"]).select("id", "th", "o", "pos", F.col("new").alias("rank")), paths)
        levels = levels.unionByName(ranks.withColumn("k", F.lit(k + 1)))
    ends = F.explode(F.array(F.struct(F.col("o").alias("at"), F.lit(0).alias("part")), F.struct((F.col("o") + F.col("m") - F.expr("shiftleft(1, k)")).alias("at"), F.lit(1).alias("part"))))
    parts = windows.withColumn("e", ends).select("id", "th", "k", F.col("e.at").alias("at"), "e.part", "o", "m", "line", "last")
    named = parts.join(levels.select("id", "th", "k", F.col("o").alias("at"), "rank"), ["id", "th", "k", "at"])
    at = lambda p: F.max(F.when(F.col("part") == p, F.col("rank")))
    named = named.groupBy("id", "th", "o", "m", "line", "last").agg(at(0).alias("a"), at(1).alias("b")).where("a is not null and b is not null")
    named = written(named, paths)
    first = named.groupBy("m", "a", "b").agg(F.min(F.struct("id", "th", "o")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = named.join(first, ["m", "a", "b"]).where(
        "id <> first.id or th <> first.th or o >= first.o + m"  # a run that overlaps its own first copy stays
    )
    return later.groupBy(*KEY).agg(F.collect_list(F.struct("line", "last")).alias("ranges"))


def keyed(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Add the document key: id (null first) and the text's hash, which orders texts that share an id."""
    return docs.withColumn("id", F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63)))).withColumn("th", F.xxhash64(F.coalesce(text, F.lit(""))))


def dedup_lines(docs: DataFrame, *, text: str = "text", id: str = "doc_id", min_words: int = 50, paths: list[str] | None = None) -> DataFrame:
    """docs with later copies of repeated line runs deleted from `text`, plus n_lines_removed.

    Runs are compared as whole lines; positions are ordered by document id (null first), text hash and line. Blank
    lines between two deleted lines go with them. Null texts stay null, documents without a copy stay as they are, rows
    repeated with the same id and text are one document, extra columns pass through (one named n_lines_removed gives way to
    the count), an empty table stays empty. A
    document that consists of copies alone ends up with an empty text.
    """
    rows = boxed(docs, F.col(text).alias("t"), F.col(id).alias("i"))
    rows = keyed(rows, "t", "i")
    used: list[str] = []
    edits = written(deletions(rows.select("id", "th", "t"), "t", min_words=min_words, paths=used), paths)
    release(docs.sparkSession, used)  # the written edits are all that is read from here on
    gone = F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.sequence(r["line"], r["last"]))))
    # edits grow with the corpus, so the plan is the same shuffle join at any size
    out = rows.join(edits.hint("merge"), KEY, "left").withColumn("gone", gone)
    out = out.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("t", "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    cut = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    out = out.withColumn("n_lines_removed", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
    return unboxed(out, docs.columns, "n_lines_removed", **{text: F.when(F.col("gone").isNull(), F.col("t")).otherwise(cut)})


def op2(docs: DataFrame) -> DataFrame:
    """The query's digest of `dedup_lines`, whose docstring states the edge cases; a null text counts as empty here."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", n_words("text").alias("n_words_left"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_left"), "n_lines_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
