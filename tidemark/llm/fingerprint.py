"""Document fingerprints: MinHash signatures by universal hashing in numpy, bands joined in Spark, Jaccard verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bloom import bloom_filter, passes
from tidemark.llm.common import slices, text_words, written
from tidemark.llm.components import components
from tidemark.llm.jaccard import search_blocks
from tidemark.llm.shingles import WIDTH, mix, shingle_set, window_hashes

PERMUTATIONS = 64
#: The multipliers and offsets of the universal hash family h -> (a h + b) mod 2^64, top half taken.
_A = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, PERMUTATIONS + 1001, dtype=np.uint64))


def minima(s: np.ndarray) -> np.ndarray:
    """64 minima of 32 bits over a set of hashes; all ones for an empty one."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(s), 1024):  # bounded memory for very long texts
        x = _A[:, None] * s[None, i : i + 1024]
        x += _B[:, None]
        np.minimum(low, x.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)  # the top half of the least is the least of the top halves


def signature(text: str | None) -> np.ndarray:
    """The minima over the text's five-word shingles; repeats do not matter."""
    return minima(window_hashes(text_words(text)))


def kept(text: str) -> str:
    """What `edited` leaves of a text."""
    return text[: len(text) - len(text) // 3]


def card(text: str) -> tuple[np.ndarray, int, np.ndarray]:
    """The signature of a text, how many of its first shingles its edited text is sure to share, and the minima over those."""
    words = text_words(text)
    hashes = window_hashes(words)
    # the last word of what is kept may be cut in two
    shared = max(0, len(text_words(kept(text))) - 1 - (WIDTH - 1)) if len(words) >= WIDTH else 0
    first = minima(hashes[:shared])
    return np.minimum(first, minima(hashes[shared:])), shared, first


def edited_signature(changed: str, own: tuple[np.ndarray, int, np.ndarray]) -> np.ndarray:
    """`signature` of the edited text of a text with this card, from the shingles that it does not share."""
    _, shared, first = own
    rest = text_words(changed)[shared:]
    if not shared:
        return minima(window_hashes(rest))
    return np.minimum(first, minima(window_hashes(rest))) if len(rest) >= WIDTH else first


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many of the first code points of the following text, or all of it."""
    return kept(text) + following[: len(text) // 3]


def fingerprints(docs: DataFrame, *, text: str = "text", id: str = "doc_id", ranges: int | None = None, classes: DataFrame | None = None) -> DataFrame:
    """Fingerprints of each row's text and of its edited text (see `edited`), with likenesses.

    The following document is the next in descending id, after the last comes the first; null ids come last in falling order of
    a hash of their text, rows that share an id follow each other by that hash. A null text is empty. Two texts without words are alike (1.0), as equal
    texts have equal fingerprints. One row in, one row out; extra columns are not read; an empty table gives an empty table.

    `classes` (doc_id, class_id) are unique ids with another class than themselves; then a column class_id follows, the id itself for the
    others, null for a null id. They travel to the ranges of their ids ahead of the texts.

    Texts are dealt once, to ranges of ids cut at sampled quantiles. Each range also gets the first document of the
    next range (one row for each range), so that a sweep in order meets every neighbour.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    # rows without an id stand below all ids, spread by the hash of their text
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63)) + F.shiftrightunsigned("th", 3)))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(c) for c in rows.approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.25 / ranges)}) if ranges > 1 else []
    # a binary search over the cuts, which are one row
    one_row = spark.createDataFrame([(cuts,)], "cuts array<long>")
    low, high = F.lit(0), F.lit(len(cuts))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.col("k") >= F.get("cuts", mid)
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~right, mid).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.lit(len(cuts).bit_length()))
    place = lambda df: df.crossJoin(F.broadcast(one_row)).withColumn("part", F.aggregate(steps, F.struct(low.alias("lo"), high.alias("hi")), halve)["lo"]).drop("cuts")
    rows = place(rows)
    top = {r["part"]: r["k"] for r in rows.groupBy("part").agg(F.max("k").alias("k")).collect()}  # a row for each range
    order = sorted(top, reverse=True)
    # the highest id of a range follows the lowest of the range above; the highest of all follows the lowest of all
    feeds = [(top[b], a) for a, b in zip(order, [*order[1:], *order[:1]], strict=True)] if order else []
    feeds_df = spark.createDataFrame(feeds, "k long, into int") if feeds else spark.createDataFrame([], "k long, into int")
    # of rows that share that id, the first in order is the neighbour
    extra = rows.join(F.broadcast(feeds_df), "k")
    first = extra.groupBy("into").agg(F.min_by(F.struct("doc_id", "text", "k", "th"), "th").alias("x"))
    extra = first.select("x.doc_id", "x.text", "x.k", F.col("into").alias("part"), "x.th", F.lit(1).alias("extra"))
    both = rows.select("doc_id", "text", "k", "part", "th", F.lit(0).alias("extra")).unionByName(extra)
    if classes is not None:
        moved = place(classes.select("doc_id", F.col("doc_id").alias("k"), F.col("class_id").alias("th"), F.lit(-1).alias("extra")))
        both = both.unionByName(moved, allowMissingColumns=True)
    dealt = both.repartition(ranges, "part").sortWithinPartitions("part", F.col("extra") > 0, F.desc("k"), "extra", "th")
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", *(["class_id"] if classes is not None else [])]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema += ", class_id long" if classes is not None else ""

    kinds = {"n_chars": pa.int64(), "doc_id": pa.int64(), "class_id": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()} | {c: pa.string() for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (part, doc_id, text, card, class_id)
        moved = (None, None)  # the last id of `classes` and its class

        def row(doc_id, text, own_card, class_id, after_text, after):
            changed, own = edited(text, after_text), own_card[0]
            new = own if changed == text else edited_signature(changed, own_card)
            out = (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own.astype(">u4").tobytes().hex(), new.astype(">u4").tobytes().hex(), likeness(own, new), likeness(own, after), class_id)
            return out[: len(columns)]

        for x in slices(batches):
            out = []
            for part, doc_id, text, th, more in zip(x["part"], x["doc_id"], x["text"], x["th"], x["extra"], strict=True):
                if more < 0:
                    moved = (doc_id, th)
                    continue
                own = last[3] if last and last[2] == text else card(text)
                if last and last[0] == part:
                    out.append(row(*last[1:], text, own[0]))
                last = None if more else (part, doc_id, text, own, moved[1] if doc_id == moved[0] else doc_id)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[name]) for name, c in zip(columns, zip(*out, strict=True), strict=True)], columns)

    return dealt.mapInArrow(sweep, schema)


#: Which minima make up each band: 24 draws of six of the 64, by a fixed seed. Two texts of Jaccard 0.8 share some band but for one in a thousand,
#: of 0.5 in three cases of ten.
BANDS = [np.random.default_rng(b).permutation(PERMUTATIONS)[:6].tolist() for b in range(24)]

#: Of 64 low halves of minima, how many two texts must share to be compared: five deviations below what a Jaccard of 0.8 gives.
ALIKE = 36


def near_duplicates(docs: DataFrame, *, text: str = "text", id: str = "doc_id", bands: list[list[int]] = BANDS, percent: int = 80, chunk: int = 4096, paths: list[str] | None = None) -> DataFrame:
    """(doc_id, class_id): classes of documents linked by a shared signature band and an exact Jaccard check.

    Every two documents of a bucket are compared or already in one class. Equal shingle sets are linked first and stand in
    the buckets once. First each bucket is a star around one of its documents, which
    joins large groups without comparing all their pairs. A star's comparison
    looks at the low halves of the minima first and, if these allow the similarity, at whole shingle sets; only documents
    that come so far have their texts read again. Then buckets that still hold several classes are connected to blocks, whose shingle
    sets are searched for all links across classes as `jaccard.search_blocks` does, in pairs of chunks if a block is large, so that no
    table of pairs is made. Null ids are left out; wordless texts stay alone.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.xxhash64("doc_id", "text"))  # which of the rows that share an id has the text

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            out = []
            for doc_id, t, k in zip(x["doc_id"], x["text"], x["k"], strict=True):
                own = shingle_set(t)
                if len(own):
                    out.append((doc_id, k, len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), minima(own).astype("<u2").tobytes()))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "k", "n", "whole", "low"])

    signed = written(rows.mapInArrow(sign, "doc_id long, k long, n long, whole binary, low binary"), paths)
    sets = signed.groupBy("whole").agg(F.min(F.struct("doc_id", "k", "n", "low")).alias("x")).select("x.*")
    keys = F.array(*[F.xxhash64(*[F.substring("low", 1 + 2 * m, 2) for m in band], F.lit(b)) for b, band in enumerate(bands)])
    banded = sets.select("k", F.explode(keys).alias("band"))
    shared = written(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), paths)
    full = spark.sparkContext.broadcast(bloom_filter(shared, "band"))

    def crowded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.loc[passes(full.value, x["h"].to_numpy()), ["k", "band"]]

    some = banded.withColumn("h", F.xxhash64("band")).mapInPandas(crowded, "k long, band long")
    banded = written(some.join(shared, "band"), paths)
    # a text that many others were copied from has the fullest buckets, so it leads the first stars
    cards = written(sets.join(banded.groupBy("k").agg(F.sum("size").alias("degree")), "k"), paths)
    low = cards.select("k", "low")

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            a, b = (np.frombuffer(b"".join(x[c]), "<u2").reshape(-1, PERMUTATIONS) for c in ("low_ku", "low_kv"))
            yield x.loc[(a == b).sum(axis=1) >= ALIKE, ["u", "v", "ku", "kv"]]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            on = []
            for u, v, a, b in zip(x["u"], x["v"], x["text_ku"], x["text_kv"], strict=True):
                s, t = shingle_set(a), shingle_set(b)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    on.append((u, v))
            if on:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*on, strict=True)], ["u", "v"])

    def texts_of(keys: DataFrame, n: int | None = None, *, sets: bool = False) -> DataFrame:
        """(k, text) of the rows with these keys and of few others, or (k, items) with their shingle sets, in one pass."""
        bloom = spark.sparkContext.broadcast(bloom_filter(keys, "k", n))

        def called(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(passes(bloom.value, b.column("h").to_numpy()))).select(["k", "text"])

        def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in slices(called(batches), 20):
                own = [shingle_set(t).view(np.int64) for t in x["text"]]
                yield pa.RecordBatch.from_arrays([pa.array(x["k"], pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["k", "items"])

        hashed = rows.select("k", "text", F.xxhash64("k").alias("h"))
        return hashed.mapInArrow(spelt, "k long, items array<long>") if sets else hashed.mapInArrow(called, "k long, text string")

    def linked(pairs: DataFrame) -> DataFrame:
        # sets too unlike in size cannot pass
        both = F.least("n", "m")
        near = pairs.where(both * 100 >= (F.col("n") + F.col("m") - both) * percent).select("u", "v", "ku", "kv").distinct()
        side = lambda df, name, c: df.select(F.col("k").alias(c), F.col(name).alias(f"{name}_{c}"))
        near = near.join(side(low, "low", "ku"), "ku").join(side(low, "low", "kv"), "kv")
        near = written(near.mapInPandas(alike, "u long, v long, ku long, kv long"), paths)
        # equal rows share k and stand once
        texts = texts_of(near.select(F.explode(F.array("ku", "kv")).alias("k")).distinct(), 2 * near.count()).dropDuplicates(["k"])
        near = near.join(side(texts, "text", "ku").hint("merge"), "ku").join(side(texts, "text", "kv").hint("merge"), "kv")
        return written(near.mapInArrow(verify, "u long, v long"), paths)

    # buckets hold one document of each set, so links and classes are theirs until the copies follow at the end
    # rows that share an id link the sets that they have
    firsts = signed.groupBy("whole").agg(F.min("doc_id").alias("first"))
    owners = signed.select("doc_id", "whole").join(firsts, "whole").select("doc_id", "first")
    least = owners.groupBy("doc_id").agg(F.min("first").alias("v"), F.max("first").alias("w"))
    links = owners.join(least.where("v <> w"), "doc_id").where("first <> v").select(F.col("first").alias("u"), "v")
    nobody = spark.createDataFrame([], "id long, component long")
    at = written(banded.select("band", "k").join(cards.select("k", "doc_id", "n", "degree"), "k"), paths)
    mates = at.groupBy("band").agg(F.min_by(F.struct("doc_id", "k", "n"), F.struct(-F.col("degree"), F.xxhash64("k"))).alias("x"))
    mates = mates.select("band", F.col("x.doc_id").alias("v"), F.col("x.k").alias("kv"), F.col("x.n").alias("m"))
    new = linked(at.withColumnsRenamed({"doc_id": "u", "k": "ku"}).join(mates, "band").where("u <> v"))
    links = links.unionByName(new)
    # each document goes with the fullest lead it is linked to, which is in its class
    leads = cards.groupBy(F.col("doc_id").alias("v")).agg(F.max("degree").alias("degree"))
    led = new.join(leads, "v").select("u", "v", "degree")
    led = led.unionByName(led.select(F.col("v").alias("u"), "v", "degree"))
    classes = led.groupBy(F.col("u").alias("id")).agg(F.max_by("v", F.struct("degree", "v")).alias("component"))
    named = written(cards.join(classes, F.col("doc_id") == F.col("id"), "left").select("k", F.coalesce("component", "doc_id").alias("label")), paths)
    # buckets across classes connect what may still link; a document is in one block, however many buckets it shares
    inside = banded.select("band", "k").join(named, "k")
    mixed = inside.groupBy("band").agg(F.min("k").alias("lead"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
    near = written(inside.join(mixed.select("band", "lead"), "band").where("k <> lead").select(F.col("k").alias("u"), F.col("lead").alias("v")).distinct(), paths)
    if near.take(1):
        blocks = written(components(near, paths), paths)
        sets = texts_of(blocks.select(F.col("id").alias("k")), sets=True).dropDuplicates(["k"]).join(named, "k")
        found = search_blocks(sets.withColumnRenamed("k", "node"), blocks, percent=percent, chunk=chunk, paths=paths)
        links = links.unionByName(found.select("u", "v"))
    links = written(links, paths)
    classes = components(links, paths) if links.take(1) else nobody
    least = least.select("doc_id", F.col("v").alias("first"))
    ids = rows.select("doc_id").distinct().join(least, "doc_id", "left").withColumn("first", F.coalesce("first", "doc_id"))
    return ids.join(classes, ids["first"] == classes["id"], "left").select("doc_id", F.coalesce("component", "first").alias("class_id"))


def op9(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row and the class of near duplicates of its id; a null id has no class. Edge cases as `fingerprints` states them."""
    moved = written(near_duplicates(docs).where("class_id <> doc_id"))
    return fingerprints(docs, classes=moved)
