"""N-gram Jaccard join: all links of a Jaccard similarity between shingle sets, by T-occurrence search (DivideSkip).

1. Documents with equal sets are one class; only its smallest id goes on.
2. Two linked sets share a shingle among the first n - ceil(t n) + 1 of either, in any one order of all shingles. The order
   here puts first the shingles that only one document has. Counting three eighths of the hash space (of every document)
   is enough to fill the prefix of a document that shares little: it has no link and leaves. A Bloom filter of bounded size
   carries the others' ids to a second read; what it lets through by chance is only compared in vain.
3. Among those left, counts are taken again, and prefixes start with the rarest shared shingles. The smallest id of each
   prefix shingle's group (a partial aggregate, joined back) stars the group; connected stars are the blocks of possible links.
4. Each block is searched by DivideSkip: a record's short inverted lists are merged by count, its long ones are probed
   by binary search, and records that reach the overlap are linked. A block of more than `chunk` sets is dealt out as pairs
   of chunks, so that a task holds two chunks at most and every pair of sets still meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bloom import bloom_filter, passes
from tidemark.llm.common import release, runs, written
from tidemark.llm.components import components
from tidemark.llm.shingles import shingle_set


def _counted(s: np.ndarray) -> np.ndarray:
    """The part of the hash space that is counted: three eighths, well over the fifth that a prefix takes."""
    return s & np.uint64(7) < np.uint64(3)


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _prefix(n: int, percent: int) -> int:
    return n - _needed(n, percent) + 1 if n else 0


class Block:
    """DivideSkip over the sets of one block, with the classes of linked records."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int):
        order = np.lexsort((ids, [len(s) for s in sets]))
        self.ids, self.sets, self.side, self.percent = ids[order], [sets[i] for i in order], side[order], percent
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.comp = np.unique(self.ids, return_inverse=True)[1].astype(np.int64)
        self.both = len(np.unique(side)) > 1
        codes = np.unique(np.concatenate(self.sets), return_inverse=True)[1]
        self.begin = np.r_[0, np.cumsum(self.size)]
        self.codes = codes
        owner = np.repeat(np.arange(len(self.sets)), self.size)
        at = np.argsort(codes, kind="stable")
        self.lists, self.start = owner[at], np.r_[0, np.cumsum(np.bincount(codes))]
        place = np.empty(len(codes), np.int64)
        place[at] = np.arange(len(codes))
        self.place = place  # where each occurrence stands in its list

    def link(self, x: int, y: int) -> None:
        a, b = sorted((self.comp[x], self.comp[y]))
        if a != b:
            self.comp[self.comp == b] = a

    def linked(self, x: int, y: int) -> bool:
        n = len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True))
        return 100 * n >= self.percent * (self.size[x] + self.size[y] - n)

    def search(self, x: int) -> None:
        """Link x to every class among the records before it (those of no more shingles)."""
        n = self.size[x]
        least = np.searchsorted(self.size, _needed(n, self.percent))
        if least >= x:
            return
        ends = self.place[self.begin[x] : self.begin[x + 1]]
        starts = self.start[self.codes[self.begin[x] : self.begin[x + 1]]]
        length = ends - starts
        held = np.flatnonzero(length)
        need = _needed(n, self.percent)
        if len(held) < need:
            return
        held = held[np.argsort(length[held], kind="stable")]
        # the class of the record before x is tried first, so that a large group of copies costs one comparison each
        for y in range(x - 1, max(least, x - 3) - 1, -1):
            if self.comp[y] != self.comp[x] and not (self.both and self.side[x] == self.side[y]) and self.linked(x, y):
                self.link(x, y)
        long = min(need - 1, int((length[held] > 64).sum()))
        short, probed = held[: len(held) - long], held[len(held) - long :]
        merged = np.concatenate([self.lists[starts[i] : ends[i]] for i in short])
        merged = merged[(merged >= least) & (self.comp[merged] != self.comp[x])]
        found, count = np.unique(merged, return_counts=True)
        found, count = found[count >= need - long], count[count >= need - long]
        if self.both:
            other = self.side[found] != self.side[x]
            found, count = found[other], count[other]
        for i in probed:
            if not len(found):
                return
            among = self.lists[starts[i] : ends[i]]
            at = np.searchsorted(among, found)
            count = count + (among[np.minimum(at, len(among) - 1)] == found)
        enough = 100 * count >= self.percent * (n + self.size[found] - count)
        for y in found[enough]:
            self.link(x, int(y))

    def labels(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids with a link to another id, and the smallest id of their class."""
        for x in range(len(self.sets)):
            self.search(x)
        low = pd.Series(self.ids).groupby(self.comp).transform("min").to_numpy()
        ids = pd.DataFrame({"u": self.ids, "v": low}).drop_duplicates()
        grouped = ids.groupby("v").u.transform("size").to_numpy() > 1
        return ids.u.to_numpy()[grouped], ids.v.to_numpy()[grouped]


def search_blocks(sets: DataFrame, blocks: DataFrame, *, percent: int, chunk: int = 4096, paths: list[str] | None = None) -> DataFrame:
    """(u, v, split): labels that sets of one block link, v the smallest of u's class; split where u's block is dealt out as pairs of chunks.

    sets has node, label and the items of a set, blocks (id, component) the block of each node. Sets of one label are linked already.
    """
    large = blocks.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    parts = F.greatest(F.ceil(F.col("size") / chunk), F.lit(1)).cast("int")
    routed = blocks.join(large.withColumn("parts", parts), "component").select(F.col("id").alias("node"), "component", "parts", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))

    full = sets.join(routed.hint("merge"), "node")
    meets = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meets = meets.withColumn("block", F.xxhash64("component", F.least("part", "other"), F.greatest("part", "other")))
    # a pair of different chunks compares across only; a chunk with itself compares inside
    meets = meets.select("block", "label", "items", F.when(F.col("part") > F.col("other"), 1).otherwise(0).alias("side"), (F.col("parts") > 1).alias("split"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, x in runs(batches, "block"):
            if len(x) > 1:
                items = [np.asarray(a, np.int64).view(np.uint64) for a in x["items"]]
                u, v = Block(x["label"].to_numpy(), items, x["side"].to_numpy(), percent).labels()
                if len(u):
                    yield pd.DataFrame({"u": u, "v": v, "split": bool(x["split"].iloc[0])})

    return written(meets.repartition("block").sortWithinPartitions("block").mapInPandas(search, "u long, v long, split boolean"), paths)


def similar(docs: DataFrame, *, text: str = "text", id: str = "doc_id", percent: int = 80, chunk: int = 4096, paths: list[str] | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs: links are 100 |A n B| >= percent |A u B|.

    component_id is the smallest id that links reach. A null or wordless text has no shingles and no links. Rows that
    share an id are one document for links, and each keeps its row. A row without an id has a null component_id. Ties
    and order do not matter; extra columns are not read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "n": [len(s) for s in sets],
                "key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "counted": [s[_counted(s)].view(np.int64) for s in sets],
            })

    sets = written(docs.mapInPandas(read, "doc_id long, n long, key binary, counted array<long>"), paths)
    first = sets.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    members = written(sets.select("doc_id", "n", "key").join(first, "key", "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), paths)
    alone = sets.where("doc_id is not null").select("doc_id", F.explode("counted").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("doc_id")).where("k = 1")
    alone = alone.groupBy("doc_id").agg(F.count(F.lit(1)).alias("alone"))
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    reps = members.where("doc_id = rep").select("doc_id", prefix.alias("p"))
    bloom = bloom_filter(written(reps.join(alone.hint("merge"), "doc_id", "left").where("p > coalesce(alone, 0)").select("doc_id").distinct(), paths))
    sent = spark.sparkContext.broadcast(bloom)

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[passes(sent.value, batch["h"].to_numpy())]
            if not len(batch):
                continue
            sets = [shingle_set(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "p": [_prefix(len(s), percent) for s in sets],
                "items": [s.view(np.int64) for s in sets],
                "counted": [s[_counted(s)].view(np.int64) for s in sets],
                "others": [s[~_counted(s)][: _prefix(len(s), percent)].view(np.int64) for s in sets],
            })

    known = docs.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h"), "text")
    left = written(known.mapInPandas(candidates, "doc_id long, p int, items array<long>, counted array<long>, others array<long>"), paths)
    rows = left.select("doc_id", F.explode("counted").alias("h"))
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = rows.join(shared.hint("merge"), "h").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))
    start = left.select("doc_id", "p", F.size("counted").alias("k"), "others").join(ranked.hint("merge"), "doc_id", "left")
    held = F.coalesce(F.size("shared"), F.lit(0))
    open_ = F.greatest(F.col("p") - (F.col("k") - held), F.lit(0))  # places that lone shingles do not fill
    start = start.withColumn("open", open_).where("open > 0")
    own = F.coalesce(F.slice(F.transform("shared", lambda x: x["h"]), 1, F.col("open")), F.array().cast("array<bigint>"))
    rest = F.slice("others", 1, F.greatest(F.col("open") - held, F.lit(0)))
    rows = start.select("doc_id", F.explode(F.concat(own, rest)).alias("h"))
    groups = rows.groupBy("h").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    stars = written(rows.join(groups.hint("merge"), "h").where("doc_id <> lead").select(F.col("doc_id").alias("u"), F.col("lead").alias("v")).distinct(), paths)
    blocks = written(components(stars, paths), paths)
    found = search_blocks(left.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("label"), "items"), blocks, percent=percent, chunk=chunk, paths=paths)
    labels = found.where("not split").select(F.col("u").alias("id"), F.col("v").alias("component"))
    split = found.where("split").select("u", "v")
    if not split.isEmpty():
        labels = labels.unionByName(components(split, paths))
    out = members.join(labels, members["rep"] == labels["id"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, text: str = "text", id: str = "doc_id", paths: list[str] | None = None) -> DataFrame:
    """docs with one row of each group of linked documents, that of the smallest id; rows without an id all stay."""
    used: list[str] = []
    found = similar(docs, text=text, id=id, paths=used)
    stay = written(found.where("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct(), paths)
    release(docs.sparkSession, used)  # the written ids are all that is read from here on
    kept = docs.join(stay.hint("merge"), docs[id].cast("long") == stay["_id"], "left_semi").dropDuplicates([id])
    return kept.unionByName(docs.where(F.col(id).isNull()))


def op5(docs: DataFrame) -> DataFrame:
    """The query's table: `similar` with its defaults, whose docstring states the edge cases."""
    return similar(docs)
