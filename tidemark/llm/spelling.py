"""Spelling variants by a dictionary of trie-node pairs.

All words are put in one forward and one reversed trie whose nodes are numbered. A word of length L has, for each
position i, the pair (node of its first i characters, node of what follows position i), and for each split the pair
(node of the first i characters, node of the rest). Two words that share a pair across a skipped position differ by one
replaced character; one whose pair across a skipped position is another's split is that one with a character inserted.
So equal pairs of integers are exactly the neighbours at one edit, and no pair of words is compared.

Tries are swept in sorted order: words are dealt to ranges at cut words, a task keeps the nodes of its last word on a stack,
and nodes on the path of a cut word, the only ones that two ranges can share, have numbers that every task knows.
"""

from __future__ import annotations

import itertools
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Maximal runs of letters once A-Z is lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words a task holds before it hands its counts on.
HOLD = 400_000


def edited(doc_id: str, run: str) -> str:
    """The run, less its code point h % length where 97 divides h = crc32 of `<doc_id>:<run>`."""
    h = zlib.crc32(f"{doc_id}:{run}".encode("utf-8", "surrogatepass"))
    at = h % len(run)
    return run if h % 97 else run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least_chars: int = 5, least: int = 3) -> DataFrame:
    """(word, n) over all whole texts, for words of at least `least_chars` code points and `least` occurrences.

    A null text has no words; a null id counts as an empty one. Tasks add up what they read before the shuffle.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                low = t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes touch A-Z alone
                for run, k in Counter(RUN.findall(low)).items():
                    word = edited(i, run)
                    if len(word) >= least_chars:
                        seen[word] = seen.get(word, 0) + k
                if len(seen) > HOLD:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
                    seen = {}
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(tally, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


def cut_words(words: DataFrame, word: str, n: int) -> list[str]:
    """Sorted words at which ranges start, about one for each shuffle partition: a bounded sample by hash, which only balances the ranges."""
    ranges = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = max(1, n // (16 * ranges))
    sample = sorted(r[0] for r in words.where(F.pmod(F.xxhash64(word), F.lit(every)) == 0).select(word).collect())  # about 16 words for each range
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []


class Sweep:
    """Numbers of trie nodes along words that come in sorted order within a range."""

    def __init__(self, cuts: list[str]):
        self.cuts, self.known = cuts, {}
        for w in cuts:
            for i in range(len(w) + 1):
                self.known.setdefault(w[:i], -1 - len(self.known))
        self.known.setdefault("", -1 - len(self.known))
        self.part, self.last, self.stack, self.next, self.index = None, "", [], 0, 0

    def add(self, part: int, word: str) -> tuple[list[int], int, int]:
        """(node of each prefix of the word, word number, prefix shared with the word before)."""
        if part != self.part:
            self.part, self.last, self.stack, self.index = part, "", [self.known[""]], 0
            self.next = part << 40
            shared = len(word) if part else 0  # what lies before the range is not seen: all may be shared
            l = 0
        else:
            l = shared = common_prefix(self.last, word)
        stack = self.stack[: l + 1]
        while l < len(word) and (k := self.known.get(word[: l + 1])) is not None:
            stack.append(k)
            l += 1
        new = len(word) - l
        stack.extend(range(self.next, self.next + new))
        self.next += new
        self.stack, self.last = stack, word
        number = (part << 40) + self.index
        self.index += 1
        return stack, number, shared

    def after(self, part: int) -> str:
        """The first word of the next range."""
        return self.cuts[part] if part < len(self.cuts) else ""


def swept(batches: Iterator[pa.RecordBatch], cuts: list[str], give, flush: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Run over rows of (part, word, ...): give(row, nodes, number, shared) returns columns' values, shared against both neighbours."""
    sweep, held, out = Sweep(cuts), None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            part, word = row[0], row[1]
            if held is not None:
                follows = word if held[0][0] == part else sweep.after(held[0][0])
                out.append((held[0], held[1], held[2], max(held[3], common_prefix(held[0][1], follows))))
            held = (row, *sweep.add(part, word))
        if len(out) >= flush:
            yield give(out)
            out = []
    if held is not None:
        out.append((held[0], held[1], held[2], max(held[3], common_prefix(held[0][1], sweep.after(held[0][0])))))
    if out:
        yield give(out)


def forward(out: list) -> pa.RecordBatch:
    """Words reversed, with their number and the nodes of prefixes that another word may share."""
    return pa.RecordBatch.from_arrays([
        pa.array([r[1][::-1] for r, *_ in out], pa.string()), pa.array([r[2] for r, *_ in out], pa.int64()),
        pa.array([number for _, _, number, _ in out], pa.int64()), pa.array([nodes[: shared + 1] for _, nodes, _, shared in out], pa.list_(pa.int64())),
    ], ["reversed", "n", "number", "prefixes"])


#: What a row of pairs stands for.
SKIPPED, SKIPPED_LAST, SPLIT = 0, 1, 2


def pairs(out: list) -> pa.RecordBatch:
    """Pairs of nodes of each word across a skipped position and at a split, as far as both nodes may be shared.

    Skipping any of several equal characters in a row gives the same word; the last of them stands for all.
    """
    found: tuple[list, ...] = ([], [], [], [], [])
    for (_, back, n, number, prefixes), nodes, _, b in out:
        size, a = len(back), len(prefixes) - 1
        for i in range(max(0, size - 1 - b), min(a, size - 1) + 1):
            last = i == size - 1 or back[size - 1 - i] != back[size - 2 - i]
            for c, v in zip(found, (prefixes[i], nodes[size - 1 - i], SKIPPED_LAST if last else SKIPPED, n, number), strict=True):
                c.append(v)
        for i in range(max(0, size - b), min(a, size) + 1):
            for c, v in zip(found, (prefixes[i], nodes[size - i], SPLIT, n, number), strict=True):
                c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["p", "s", "kind", "n", "number"])


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted pairs (by p, s, then n downwards and number): for each word of a pair, how many words it meets there and the best of them.

    A pair has at most one word at a split, which is the one that prefix and suffix spell, and at most one word for each
    letter across a skipped position, so groups are bounded by the alphabet.
    """
    kept: list[np.ndarray] | None = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if kept is not None:
                now = [np.concatenate(c) for c in zip(kept, now, strict=True)]
            if not len(now[0]):
                continue
            p, s = now[0], now[1]
            cut = len(p) - 1
            same = np.flatnonzero((p != p[cut]) | (s != s[cut]))
            cut = int(same[-1]) + 1 if len(same) else 0
            kept, now = [c[cut:] for c in now], [c[:cut] for c in now]
        elif kept is None:
            return
        else:
            now, kept = kept, None
        if len(now[0]):
            yield _met(*now)


def _met(p: np.ndarray, s: np.ndarray, kind: np.ndarray, n: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    group = np.cumsum(np.r_[True, (p[1:] != p[:-1]) | (s[1:] != s[:-1])]) - 1
    groups = int(group[-1]) + 1
    found = []

    def firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each group the number of the given rows, the first of them and the second (-1: none)."""
        g = group[rows]
        count = np.bincount(g, minlength=groups)
        first, second = np.full(groups, -1), np.full(groups, -1)
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, int)
        first[g[start]] = rows[start]
        more = start[count[g[start]] > 1]
        second[g[more]] = rows[more + 1]
        return count, first, second

    skipped, last, split = np.flatnonzero(kind != SPLIT), np.flatnonzero(kind == SKIPPED_LAST), np.flatnonzero(kind == SPLIT)
    count, first, second = firsts(skipped)
    at = skipped[count[group[skipped]] > 1]  # one replaced: all others that skip here
    found.append((at, count[group[at]] - 1, np.where(first[group[at]] == at, second[group[at]], first[group[at]])))
    count, first, _ = firsts(last)
    at = split[count[group[split]] > 0]  # one inserted in the others
    found.append((at, count[group[at]], first[group[at]]))
    count, first, _ = firsts(split)
    at = last[count[group[last]] > 0]  # one deleted
    found.append((at, count[group[at]], first[group[at]]))
    rows, counts, best = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(number[rows]), pa.array(counts.astype(np.int64)), pa.array(n[best]), pa.array(number[best])], ["number", "n_near", "best_n", "best"])


def neighbours(words: DataFrame, *, paths: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Words numbered in code-point order (number, word, n), and (number, n_near, best_n, best) of those that have a word at one edit.

    `words` is a written table of distinct (word, n). best is the near word of the largest n, the first in order if several are.
    """
    n = words.count()
    cuts = cut_words(words, "word", n)
    back_cuts = cut_words(words.select(F.reverse("word").alias("word")), "word", n)

    def deal(points: list[str]):
        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                part = pa.array([bisect_right(points, w) for w in b.column(0).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part, *b.columns], ["part", *b.schema.names])

        return put

    dealt = words.select("word", "n").mapInArrow(deal(cuts), "part bigint, word string, n bigint")
    rows = dealt.repartition("part").sortWithinPartitions("part", "word").mapInArrow(lambda it: swept(it, cuts, forward), "reversed string, n bigint, number bigint, prefixes array<bigint>")
    rows = written(rows, paths)
    dealt = rows.mapInArrow(deal(back_cuts), f"part bigint, {rows.schema.simpleString()[7:-1]}").repartition("part").sortWithinPartitions("part", "reversed")
    both = dealt.mapInArrow(lambda it: swept(it, back_cuts, pairs), "p bigint, s bigint, kind bigint, n bigint, number bigint")
    both = both.select("p", "s", F.col("kind").cast("byte"), "n", "number").repartition("p", "s").sortWithinPartitions("p", "s", F.desc("n"), "number")
    near = both.mapInArrow(met, "number bigint, n_near bigint, best_n bigint, best bigint")
    near = near.groupBy("number").agg(F.sum("n_near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("m"))).alias("top"))
    return rows.select("number", F.reverse("reversed").alias("word"), "n"), near.select("number", "n_near", F.col("top.best_n").alias("best_n"), (-F.col("top.m")).alias("best"))


def last_of_chains(links: DataFrame, *, paths: list[str] | None = None) -> DataFrame:
    """(number, root) for links (number, form): form followed to the end. Each round follows twice as many links; n doubles at each, so few rounds do."""
    roots = written(links.select("number", F.col("form").alias("root")), paths)
    while True:
        further = roots.select(F.col("number").alias("root"), F.col("root").alias("next"))
        longer = written(roots.join(further, "root", "left").select("number", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), paths)
        roots = longer.select("number", "root")
        if longer.where("moved").isEmpty():
            return roots


def variants(words: DataFrame, *, times: int = 2, paths: list[str] | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct words with counts.

    form is the near word of the largest count (ties: first in code-point order) if it is at least `times` the word's own,
    else null; root is where forms lead, the word itself without one.
    """
    words, near = neighbours(written(words, paths), paths=paths)
    taken = F.col("best_n") >= times * F.col("n")
    held = written(
        words.join(near, "number", "left").select("number", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n")), paths
    )
    roots = last_of_chains(held.where("form is not null").select("number", "form"), paths=paths)
    named = held.select("number", "word")
    out = held.where("form is not null").join(roots, "number")
    out = out.join(named.select(F.col("number").alias("form"), F.col("word").alias("form_word")), "form").join(named.select(F.col("number").alias("root"), F.col("word").alias("root_word")), "root")
    out = out.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")
    none = held.where("form is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return out.unionByName(none)


def op12(docs: DataFrame) -> DataFrame:
    """The query's words. Null texts have none, a null id counts as empty, repeated rows count each, an empty table gives no row, other columns are not read."""
    return variants(word_counts(docs))


#: crc32 by a table of 256 entries that a rule makes; letters beyond ASCII are two bytes in UTF-8.
ORACLE = r"""
WITH c AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END + z) ORDER BY i) AS tab FROM range(0, 256) AS r(i)),
o AS MATERIALIZED (SELECT doc_id, low, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS low FROM documents) GROUP BY doc_id, low),
b AS (SELECT low, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || low, ''), lambda q: CASE WHEN unicode(q) < 128 THEN [unicode(q)::BIGINT] ELSE [195::BIGINT, unicode(q)::BIGINT - 64] END)) AS bytes FROM o WHERE length(low) >= 5),
h AS (SELECT low, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, q: xor(s >> 8, tab[1 + (xor(s, q) & 255)]))) AS h FROM b, c),
e AS (SELECT CASE WHEN h % 97 = 0 THEN substr(low, 1, h % length(low)) || substr(low, h % length(low) + 2) ELSE low END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, cast(sum(n) AS bigint) AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less, length(word) AS l FROM w, unnest(range(0, length(word))) AS u(i)),
p AS (SELECT x.word, y.word AS other, y.n FROM d x JOIN d y ON x.less = y.less AND x.i = y.i AND x.l = y.l AND x.word <> y.word
  UNION SELECT w.word, d.word, d.n FROM w JOIN d ON d.less = w.word UNION SELECT d.word, w.word, w.n FROM w JOIN d ON d.less = w.word),
g AS (SELECT word, count(*) AS n_near, max(n) AS best_n FROM p GROUP BY word),
t AS (SELECT p.word, min(p.other) AS best FROM p JOIN g ON g.word = p.word AND p.n = g.best_n GROUP BY p.word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n FROM w LEFT JOIN g USING (word) LEFT JOIN t USING (word)),
k AS (WITH RECURSIVE q AS (SELECT word, word AS root FROM f UNION ALL SELECT q.word, f.form FROM q JOIN f ON f.word = q.root WHERE f.form IS NOT NULL) SELECT q.word, q.root FROM q JOIN f ON f.word = q.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN k USING (word)
"""
