"""Toxicity by a noisy channel: obfuscated spellings are decoded by Viterbi under a character model, then words are scored.

1. Character trigrams of all documents are counted in Spark (at most 64^3 counters).
2. A token with look-alike characters, inner separators, repeated letters, or spelt out with gaps, becomes a lattice of
   any length: each position offers letters (or nothing, or the end of a word) at a channel cost, and the cheapest path
   under the trigram model gives the restored words; two neighbours also count as one word.
3. Words and word beginnings of labelled training rows, as 64-bit hashes, are counted in Spark; every one of enough weight
   and support is in the lexicon. Up to `most` entries (16 bytes each) go out to the tasks, a larger lexicon is joined.
4. A logistic curve over the weights found in a document, fitted on a bounded sample of labelled rows, gives the score.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Letters that a character may stand for.
LOOKALIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = "._-*~^'`,·/\\"
EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$|([%&$*!#?])\1+$")
ODD = re.compile(r"(.)\1\1|[^\W\d_][\d@$!|+(€£._*~^-]|[\d@$!|+(€£._*~^-][^\W\d_]|(?<![^\W\d_])[^\W\d_]['`,·/\\][^\W\d_]['`,·/\\]")
TRIPLE = re.compile(r"(.)\1\1")
PARTS = re.compile(r"[,/;:\\]+")
BEGINNINGS = (3, 4, 5, 6)
SAMPLE = 20_000
#: Lexicon entries that go out to every task: 16 MB.
MOST = 1 << 20
SLICE = 500_000


def letter(c: str) -> int:
    """1 to 26 for a to z, 27 to 62 for other letters by code, 0 for a word's edge."""
    o = ord(c) - 96
    return o if 1 <= o <= 26 else 27 + ord(c) % 36


def codes() -> np.ndarray:
    """`letter` of every code point, 0 where none: up to U+024F all signs after z count as letters, beyond it letters alone."""
    out = np.zeros(0x110000, np.uint8)
    for o in [*range(97, 0x250), *(o for o in range(0x250, 0x110000) if chr(o).isalpha())]:
        out[o] = letter(chr(o))
    return out


def channel(c: str, run: int) -> list[tuple[str, float]]:
    """What `run` times the character c may stand for, with the channel's cost; a blank is the end of a word."""
    options: list[tuple[str, float]] = []
    letters = LOOKALIKE.get(c, c if c.isalpha() else "")
    for x in letters:
        noise = 0.0 if x == c else 0.5
        options.append((x, noise + (1.0 if run > 2 else 0.0 if run == 1 else 1.5)))
        if run > 1:
            options.append((x + x, noise + (1.5 if run > 2 else 0.0)))
    if c in SEPARATORS:
        options += [("", 0.5), (" ", 0.5)]
    elif not c.isalpha():
        options.append(("", 14.0 if letters else 1.0))
    return options


class CharModel:
    """Trigram log probabilities over letters, add-one over 64 symbols; a word starts from two edges."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(64, 64, 64).astype(float)
        self.cost = (-np.log((c + 1) / (c.sum(-1, keepdims=True) + 64))).ravel().tolist()

    def decode(self, text: str, gap: float | None = None) -> tuple[float, list[str]]:
        """Cost and words of the likeliest plain spelling of a whole token, of any length. gap: cost of a word's end that no separator shows."""
        cost = self.cost
        # last two letters -> (cost, (piece, what came before)); (0, 0) is the start of a word
        beams: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        i, n = 0, len(text)
        while i < n:
            c, run = text[i], 1
            while i + run < n and text[i + run] == c:
                run += 1
            i += run
            options = channel(c, run)
            nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (so_far, path) in beams.items():
                for piece, noise in options:
                    p, q, total = a, b, so_far + noise
                    if piece == " ":
                        if not b:
                            continue
                        total += cost[p << 12 | q << 6]
                        p = q = 0
                    else:
                        for x in piece:
                            r = letter(x)
                            total += cost[p << 12 | q << 6 | r]
                            p, q = q, r
                    best = nxt.get((p, q))
                    if best is None or total < best[0]:
                        nxt[p, q] = (total, (piece, path) if piece else path)
            if gap is not None and i < n:
                for (a, b), (so_far, path) in list(nxt.items()):
                    total = so_far + gap + cost[a << 12 | b << 6]
                    best = nxt.get((0, 0))
                    if b and (best is None or total < best[0]):
                        nxt[0, 0] = (total, (" ", path))
            beams = nxt
        total, path = min(((t + cost[a << 12 | b << 6] if b else t, p) for (a, b), (t, p) in beams.items()), key=lambda x: x[0])
        pieces = []
        while path is not None:
            pieces.append(path[0])
            path = path[1]
        return total, "".join(reversed(pieces)).split()

    def restore(self, token: str, gap: float | None = None) -> list[str]:
        """The restored words, and every two neighbours as one word."""
        words = self.decode(token, gap)[1]
        return words + [a + b for a, b in zip(words, words[1:], strict=False)]


def spellings(word: str, model: CharModel | None) -> set[str]:
    """A token's forms: itself without edge marks, its parts between marks, and restored words."""
    if word.isalpha() and not (model and ODD.search(word)):
        return {word}
    w = EDGE.sub("", word)
    out = {w}
    if len(parts := PARTS.split(w)) > 1:
        out.update(EDGE.sub("", x) for x in parts)
    if model and ODD.search(w):
        out.update(model.restore(w))
    out.discard("")
    return out


def spelt_out(words: list[str]) -> Iterator[str]:
    """Runs of three or more single characters, joined."""
    one = np.fromiter(map(len, words), np.int64, len(words)) == 1
    edge = np.flatnonzero(np.diff(np.r_[0, one.astype(np.int8), 0]))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if b - a >= 3 and len(set(words[a:b])) > 2:
            yield "".join(words[a:b])


def tokens(text: str, model: CharModel | None) -> set[str]:
    """Distinct words of a whole text, lower-cased, with the restored forms of obfuscated ones."""
    words = text.lower().split()
    out = set().union(*(spellings(w, model) for w in set(words))) if words else set()
    for run in spelt_out(words) if model else ():
        out.update(model.restore(run, gap=0.0))
        out.add("".join(model.decode(run)[1]))
    return out


def features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings, which a star marks."""
    out, n = [xxhash.xxh3_64_intdigest(word)], len(word)
    for k in BEGINNINGS:
        if n <= k:
            break
        out.append(xxhash.xxh3_64_intdigest(word[:k] + "*"))
    return out


class Reader:
    """What texts show. Each task caches tokens in two generations of `size`: the older goes when the younger is full."""

    def __init__(self, counts: np.ndarray, keys: np.ndarray | None = None, weights: np.ndarray | None = None, size: int = 150_000):
        self.model, self.keys, self.weights, self.size = CharModel(counts), keys, weights, size
        self.young: dict[str, bytes | tuple] = {}
        self.old: dict[str, bytes | tuple] = {}

    def _seen(self, words: list[str], look) -> list:
        """look(forms) of each distinct token and of each spelt-out run."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old, model, out, new, fresh = self.young, self.old, self.model, [], [], []
        for w in set(words):
            found = young.get(w)
            if found is None:
                found = old.get(w)
                if found is None:
                    new.append(w)
                    fresh.append((w,) if w.isalpha() and not TRIPLE.search(w) else spellings(w, model))
                    continue
                young[w] = found
            out.append(found)
        runs = {f for run in spelt_out(words) for f in (*model.restore(run, gap=0.0), "".join(model.decode(run)[1])) if f}
        values = look([*fresh, runs])
        young.update(zip(new, values, strict=False))
        return out + values

    @staticmethod
    def _hashes(batch: list) -> list[bytes]:
        return [array("Q", [h for f in forms for h in features(f)]).tobytes() for forms in batch]

    def features(self, text: str) -> np.ndarray:
        """Distinct features of a text."""
        return np.unique(np.frombuffer(b"".join(self._seen(text.lower().split(), self._hashes)), np.uint64))

    def _weighted(self, batch: list) -> list[tuple]:
        """For each set of forms the (form, weight) of those with a feature in the lexicon, its largest weight."""
        hashes, spans = array("Q"), []
        for i, forms in enumerate(batch):
            for f in forms:
                spans.append((i, f, len(hashes)))
                hashes.extend(features(f))
        h = np.frombuffer(hashes, np.uint64) if spans else np.empty(0, np.uint64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        w = np.where(self.keys[at] == h, self.weights[at], 0.0)
        out: list[tuple] = [()] * len(batch)
        starts = [s for _, _, s in spans]
        best: dict[int, float] = {}
        for k in np.flatnonzero(w):
            j = bisect_right(starts, k) - 1
            best[j] = max(best.get(j, 0.0), float(w[k]))
        for j, x in best.items():
            out[spans[j][0]] += ((spans[j][1], x),)
        return out

    def evidence(self, text: str) -> tuple[float, float, float]:
        """Largest weight found, logarithm of the summed weights, and of the number of words with weight."""
        if not len(self.keys):
            return 0.0, 0.0, 0.0
        return summary(list({f: w for part in self._seen(text.lower().split(), self._weighted) for f, w in part}.values()))


def summary(found: list[float]) -> tuple[float, float, float]:
    return (max(found), float(np.log1p(sum(sorted(found)))), float(np.log1p(len(found)))) if found else (0.0, 0.0, 0.0)


def char_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of whole texts, in slices of a bounded size that overlap by two characters."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = codes()
        total = np.zeros(1 << 18, np.int64)
        for x in batches:
            for text in x["text"]:
                text = f"\n{text.lower()} "
                for at in range(0, max(len(text) - 2, 1), SLICE):
                    chars = np.frombuffer(text[at : at + SLICE + 2].encode("utf-32-le", "replace"), np.uint32)
                    c = code[chars].astype(np.int32)
                    a, b, d = c[:-2], c[1:-1], c[2:]
                    cells, n = np.unique(np.where(b == 0, 0, a) << 12 | b << 6 | d, return_counts=True)  # a word starts from two edges
                    total[cells] += n
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at.astype(np.int32), "n": total[at]})

    rows = docs.select("text").mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 64^3 cells at most
    total = np.zeros(1 << 18, np.int64)
    for cell, n in rows:
        total[cell] = n
    return total


def lexicon(labelled: DataFrame, counts: np.ndarray, *, support: int, weight: float) -> DataFrame:
    """(feature, w) for every feature of at least `support` toxic rows that weighs enough against all clean rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(counts)
        held: tuple[list, list] = ([], [])

        def flush() -> pd.DataFrame:
            parts = []
            for y, found in enumerate(held):
                keys, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
                parts.append(pd.DataFrame({"feature": keys.view(np.int64), "n": n * y, "c": n * (1 - y)}))
                found.clear()
            return pd.concat(parts)

        size = 0
        for x in batches:
            for t, y in zip(x["text"], x["label"], strict=True):
                held[int(y)].append(reader.features(t))
                size += len(held[int(y)][-1])
                if size > 2_000_000:
                    yield flush()
                    size = 0
        yield flush()

    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    n, c = F.col("n"), F.col("c")
    both = labelled.mapInPandas(count, "feature long, n long, c long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    w = F.log((n + 0.5) / (toxic - n + 0.5)) - F.log((c + 0.5) / (clean - c + 0.5))
    # as strong as the rarest evidence allows: precision of the feature among labelled rows
    return both.where((n >= support) & (n >= 3 * c)).select("feature", w.alias("w")).where(F.col("w") >= weight)


def evidence(rows: DataFrame, counts: np.ndarray, words: DataFrame, keep: list[str], *, most: int = MOST) -> DataFrame:
    """rows' columns `keep` plus a, b, c: what `Reader.evidence` finds in the column text. words is the written lexicon."""
    kinds = ", ".join(f"{k} {t}" for k, t in rows.select(keep).dtypes)
    if words.count() <= most:
        found = words.toPandas().sort_values("feature", key=lambda s: s.astype(np.int64).to_numpy().view(np.uint64))
        keys, weights = found["feature"].to_numpy(np.int64).view(np.uint64), found["w"].to_numpy(np.float64)
        sent = rows.sparkSession.sparkContext.broadcast((counts, keys, weights))

        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader = Reader(*sent.value)
            for x in batches:
                e = np.array([reader.evidence(t) for t in x["text"]]).reshape(-1, 3)
                yield x[keep].assign(a=e[:, 0], b=e[:, 1], c=e[:, 2])

        return rows.select(*keep, "text").mapInPandas(apply, f"{kinds}, a double, b double, c double")

    rows = written(rows.select(*keep, "text", F.monotonically_increasing_id().alias("row")))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = CharModel(counts)
        for x in batches:
            for row, t in zip(x["row"], x["text"], strict=True):
                found = [(xxhash.xxh3_64_intdigest(f), h) for f in tokens(t, model) for h in features(f)]
                at = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
                yield pd.DataFrame({"row": row, "form": at[:, 0], "feature": at[:, 1]})

    hits = rows.select("row", "text").mapInPandas(spread, "row long, form long, feature long").join(words, "feature")
    best = hits.groupBy("row", "form").agg(F.max("w").alias("w")).groupBy("row").agg(F.max("w").alias("a"), F.log1p(F.sum("w")).alias("b"), F.log1p(F.count(F.lit(1)).cast("double")).alias("c"))
    return rows.select("row", *keep).join(best, "row", "left").select(*keep, *[F.coalesce(x, F.lit(0.0)).alias(x) for x in "abc"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; intercept last."""
    x = np.c_[x, np.ones(len(x))]
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - ridge * beta
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), grad)
    return beta


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", id: str = "doc_id", label: str = "toxic", folds: int = 5, support: int = 5, weight: float = 2.5, sample: int = SAMPLE, most: int = MOST
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; scores depend on texts alone.

    Rows whose crc32 of the id as text is 0 modulo `folds` are never learned from; the others with a label are. Counts and
    the lexicon cover all of these; the logistic curve is fitted on about `sample` of them, picked by a hash of their text.
    A null text is empty; a null id has no label and counts as the text ''. Repeated rows keep their rows; without labels
    of both kinds the score is the intercept's. Extra columns are not read; an empty table gives an empty table.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(id).alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    # labels grow with the corpus, so the plan is the same shuffle join at any size
    labelled = written(rows.where(~held).join(marks.hint("merge"), "doc_id").select("text", "label"))
    counts = char_counts(rows)
    words = written(lexicon(labelled, counts, support=support, weight=weight))
    share = min(1.0, sample / max(1, labelled.count()))
    part = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    fitted = evidence(part, counts, words, ["label"], most=most).toPandas()  # about `sample` rows of four numbers
    beta = [float(b) for b in logistic(fitted[["a", "b", "c"]].to_numpy(float).reshape(-1, 3), fitted["label"].to_numpy(float))]
    z = sum((F.col(x) * b for x, b in zip("abc", beta, strict=False)), F.lit(beta[3]))
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    out = evidence(rows.withColumn("held_out", held), counts, words, ["doc_id", "held_out"], most=most).withColumn("score", score)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's table: `score_toxicity` of every document with its defaults, whose docstring states the edge cases."""
    return score_toxicity(docs, labels)
