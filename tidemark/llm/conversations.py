"""Conversation prefix trie by collapse of whole sequences.

Identical conversations become one weighted sequence with the list of conversations that end there. Every prefix of a
distinct sequence is a node; sequences that are proper prefixes of others fall out by an anti-join, which leaves the
leaves; weights, leaves and saved words of a node are sums over the sequences that pass through it.

A prefix is known by its length and two 64-bit hashes, each the exclusive or of the hashes of (position, turn) of its
turns: these are running values, which tasks form over ranges of a conversation. No conversation, group of identical
conversations or list of ends is ever gathered in one row or task; texts are hashed where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import n_words, written
from tidemark.llm.ranges import running

#: The columns that name a node: depth and two hashes.
NODE = ["depth", "a", "b"]


def turns_of(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, late, turn, a, b, words) of every row: a and b hash role and text, in which null counts as empty; a null turn comes first.

    Rows without a conv_id belong to no conversation and go. Extra columns are not read.
    """
    role, text_ = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    return conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).isNotNull().alias("late"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
        F.xxhash64(role, text_).alias("a"), F.xxhash64(F.lit(1), text_, role).alias("b"), n_words(text).alias("words"),
    )


def rebuilt(turns: DataFrame, *, every: int = 20, most: int = 4, paths: list[str] | None = None) -> DataFrame:
    """(conv_id, depth, a, b, words): each conversation with its first h turns replaced by those of conversation c - c % every.

    h = crc32(decimal conv_id) % most. Where that conversation has fewer turns, all of them are taken; where it is absent,
    none. Depth counts from 1; turns of equal number are ordered by their hashes. A conversation left without turns has
    a row of depth 0 like all others.
    """
    numbered = running(turns, "conv_id", ["late", "turn", "a", "b"], count="n", paths=paths)
    # at most most - 1 turns for each conversation
    opening = numbered.where(F.col("n") < most).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "a", "b", "words"))).alias("opening"))
    opening = written(opening, paths)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    source = opening.select(F.col("conv_id").alias("source"), F.col("opening").alias("lead"))
    none = F.array().cast(dict(opening.dtypes)["opening"])
    convs = opening.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("source")).join(source, "source", "left")
    convs = written(convs.select("conv_id", "h", F.slice(F.coalesce("lead", none), F.lit(1), F.col("h")).alias("lead")), paths)
    own = numbered.join(convs.select("conv_id", "h", F.size("lead").alias("k")), "conv_id").where("n > h")
    lead = convs.select("conv_id", F.explode("lead").alias("t")).select("conv_id", F.col("t.n").alias("depth"), "t.a", "t.b", "t.words")
    zero = F.lit(0).cast("long")
    return own.select("conv_id", (F.col("n") - F.col("h") + F.col("k")).alias("depth"), "a", "b", "words").unionByName(lead).unionByName(
        convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("words"))
    )


def ends_hash(members: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): SHA-256 of the decimal conv_ids of each sequence, ascending, joined by commas.

    Ids are sorted by ranges, so that a sequence of very many conversations spans several tasks; each batch of a range
    becomes one piece of text, and the pieces are hashed in order as they stream by.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            node, ids = x[NODE].to_numpy(), x["conv_id"].tolist()
            first = [0, *((node[1:] != node[:-1]).any(axis=1).nonzero()[0] + 1).tolist()]
            out = x.iloc[first].rename(columns={"conv_id": "first"})
            yield out.assign(ids=[",".join(map(str, ids[i:j])) for i, j in zip(first, [*first[1:], len(ids)], strict=True)])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h, found = None, None, []
        for x in batches:
            for *node, ids in zip(x["depth"], x["a"], x["b"], x["ids"], strict=True):
                if node != now:
                    if now is not None:
                        found.append((*now, h.hexdigest()))
                    now, h = node, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if len(found) > 10000:
                yield pd.DataFrame(found, columns=[*NODE, "ends_sha256"])
                found = []
        if now is not None:
            found.append((*now, h.hexdigest()))
        if found:
            yield pd.DataFrame(found, columns=[*NODE, "ends_sha256"])

    key = "depth bigint, a bigint, b bigint"
    parts = members.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInPandas(pieces, f"{key}, first bigint, ids string")
    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInPandas(joined, f"{key}, ends_sha256 string")


def prefix_trie(turns: DataFrame, *, paths: list[str] | None = None) -> DataFrame:
    """Nodes of the trie of conversations given as (conv_id, depth, a, b, words), each with a row of depth 0.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. An
    empty table gives no node, not even a root. saved_tokens is what storing each prefix once saves: of every sequence
    through a node its weight times the words from there on, less the words that it alone accounts for, which are those
    of the nodes whose smallest member it holds; they make up a tail of the sequence.
    """
    deep = F.col("depth") > 0
    zero = F.lit(0).cast("long")
    rows = turns.select("conv_id", "depth", *[F.when(deep, F.xxhash64(F.lit(k), "depth", c)).otherwise(zero).alias(c) for k, c in ((0, "a"), (1, "b"))], "words", F.col("words").alias("upto"))
    rows = rows.withColumns({"own_a": F.col("a"), "own_b": F.col("b")})
    rows = written(running(rows, "conv_id", ["depth"], sums=["upto"], xors=["a", "b"], paths=paths), paths)

    members = rows.groupBy("conv_id").agg(F.max_by(F.struct(*NODE, "upto"), "depth").alias("s")).select("conv_id", "s.*")
    members = written(members, paths)
    sequences = written(members.groupBy(*NODE).agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id"), F.max("upto").alias("total")), paths)
    held = sequences.select("conv_id", "weight", "total", F.col("depth").alias("length"))
    through = written(rows.join(held, "conv_id").withColumn("left", F.col("total") - F.col("upto") + F.col("words")), paths)

    parent = [F.min(F.col(c).bitwiseXOR(F.col(f"own_{c}"))).alias(f"up_{c}") for c in ("a", "b")]
    nodes = written(through.groupBy(*NODE).agg(F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("words").alias("words"), *parent), paths)
    tails = nodes.groupBy("conv_id").agg(F.min("depth").alias("from"), F.sum("words").alias("tail"))
    proper = through.where("depth < length").select(*NODE).distinct()
    leaves = sequences.join(proper, NODE, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    facts = written(sequences.select("conv_id").join(tails, "conv_id", "left").join(leaves, "conv_id", "left"), paths)
    alone = F.when(F.col("depth") >= F.col("from"), F.col("left")).otherwise(F.coalesce("tail", zero))
    sums = through.join(facts, "conv_id").groupBy(*NODE).agg(F.sum(F.col("weight") * F.col("left") - alone).alias("saved_tokens"), F.sum(F.coalesce("leaf", zero)).alias("n_leaves"))

    up = [(F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")]
    children = nodes.where(deep).groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    # a node below the first of its smallest member shares it with its parent; those of depth 1 hang on the root, one row
    branches = nodes.join(tails.select("conv_id", F.col("from").alias("depth")), ["conv_id", "depth"]).where("depth > 1")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("branch_of"))
    branches = branches.select(*NODE, "up_a", "up_b").join(above, ["depth", "up_a", "up_b"]).select(*NODE, "branch_of")
    root = nodes.where("depth = 0").select(F.col("conv_id").alias("root"))
    out = nodes.join(sums, NODE).join(children, NODE, "left").join(branches, NODE, "left").join(ends_hash(members), NODE, "left").crossJoin(F.broadcast(root))
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") == 1, F.col("root")).when(deep, F.coalesce("branch_of", "conv_id")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def weighted_sequences(turns: DataFrame, *, paths: list[str] | None = None) -> DataFrame:
    """(conv_id, depth, weight) of each distinct conversation of `rebuilt` turns: its smallest member, its turns and how many conversations equal it."""
    deep = F.col("depth") > 0
    hashes = [F.when(deep, F.xxhash64(F.lit(k), "depth", c)).otherwise(F.lit(0)).alias(c) for k, c in ((0, "a"), (1, "b"))]
    whole = turns.select("conv_id", "depth", *hashes).groupBy("conv_id").agg(F.max("depth").alias("depth"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    return whole.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight")).select("conv_id", "depth", "weight")


def op11(conversations: DataFrame) -> DataFrame:
    """The query's nodes. Edge cases as stated at `turns_of`, `rebuilt` and `prefix_trie`; repeated rows count as turns of their own."""
    return prefix_trie(rebuilt(turns_of(conversations)))


#: crc32 of a decimal id, bit by bit; nodes as lists of turns.
ORACLE = r"""
WITH t AS (SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(x ORDER BY n) AS xs,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda q: unicode(q)::BIGINT)),
    lambda s, q: list_reduce(list_prepend(xor(s, q), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END + z))) % 4 AS h
  FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(list_slice(coalesce(b.xs, []), 1, c.h), list_slice(c.xs, c.h + 1, len(c.xs))) AS xs FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, xs, d, list_slice(xs, 1, d) AS k FROM r, unnest(range(0, len(xs) + 1)) AS u(d)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len(xs)) AS ends,
  CASE WHEN d = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(k[d].t, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS words FROM p GROUP BY k, d),
ch AS (SELECT list_slice(k, 1, d - 1) AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
s AS (SELECT list_slice(n.k, 1, g.d) AS k, sum((n.n - 1) * n.words) AS saved, count(*) FILTER (ch.k IS NULL) AS leaves FROM n LEFT JOIN ch ON ch.k = n.k, unnest(range(0, n.d + 1)) AS g(d) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(ch.n, 0) AS n_children, cast(s.leaves AS bigint) AS n_leaves, cast(s.saved AS bigint) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN s ON s.k = n.k LEFT JOIN ch ON ch.k = n.k LEFT JOIN n up ON n.d > 0 AND up.k = list_slice(n.k, 1, n.d - 1)
"""
