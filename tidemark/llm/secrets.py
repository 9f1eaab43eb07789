"""Secret scans with corpus-wide ownership frequency.

Each text is scanned once for the base kinds and for further candidates: long tokens that mix letters and digits at
random. Values are counted by hash over the whole corpus, by distinct owners and distinct repositories. A value that many
owners carry is a copied example; one that few carry looks live, and its spans are added where the base rules see none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Kinds in their order; token is the method's own.
KINDS = ["assign", "access", "hex", "token"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+_]{20,}")

Span = tuple[int, int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end, value) of the base rules, by start, then kind. Kinds are found apart and may overlap.

    Short assignments are found and dropped, as what they cover is used up; runs of the other two kinds are whole, so
    that asking for the length at once finds the same.
    """
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    return sorted(found + [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)])


def bits_per_char(token: str) -> float:
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values())


def token_spans(text: str, base: list[Span], bits: float) -> list[Span]:
    """Tokens outside all base spans that hold letters and digits and at least `bits` bits per character."""
    found, at, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        t = m[0]
        if t.isalpha() or not any(c.isalpha() for c in t) or bits_per_char(t) < bits:
            continue
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start():
            found.append((m.start(), 3, m.end(), t))
    return found


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.int64())]))


def scan(docs: DataFrame, owner: Column, *, id: str = "doc_id", text: str = "text", bits: float = 3.2) -> DataFrame:
    """(at, doc_id, owner, repository, n_assign, n_access, n_hex, base_sha256, spans) of each row; at numbers rows.

    A null text counts as empty, a null owner as one owner of its own. Exact copies of a text stand for one repository.
    """
    kind = dict(docs.dtypes)[id]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, shas, spans = ([], [], []), [], []
            for t in b.column("text").to_pylist():
                base = base_spans(t)
                kinds = [k for _, k, _, _ in base]
                for k, c in enumerate(counts):
                    c.append(kinds.count(k))
                shas.append(hashlib.sha256(written_out(base).encode()).hexdigest())
                both = base + token_spans(t, base, bits)
                spans.append([{"start": a, "kind": k, "end": z, "value": xxhash.xxh64_intdigest(v) - (1 << 63)} for a, k, z, v in both])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("at", "doc_id", "owner", "repository")), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, SPANS)],
                ["at", "doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("at"), F.col(id).alias("doc_id"), F.coalesce(owner.cast("string"), F.lit("\x00null")).alias("owner"), F.xxhash64(whole).alias("repository"), whole.alias("text"))
    return rows.mapInArrow(
        find,
        f"at bigint, doc_id {kind}, owner string, repository bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans array<struct<start:int,kind:int,end:int,value:bigint>>",
    )


def ownership(spans: DataFrame) -> DataFrame:
    """(value, n_spans, n_owners, n_repositories) of (value, owner, repository) rows: exact, by distinct pairs first, so that a value found everywhere is spread."""
    counts = spans.groupBy("value").agg(F.count(F.lit(1)).alias("n_spans"))
    distinct = spans.groupBy("value").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repository").alias("n_repositories"))
    return counts.join(distinct, "value")


def secrets(docs: DataFrame, *, id: str = "doc_id", text: str = "text", owner: Column | None = None, most_owners: int = 2, bits: float = 3.2, paths: list[str] | None = None) -> DataFrame:
    """Each row's base counts and hash, and all spans: the base ones, and tokens whose value at most `most_owners` owners carry.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live (spans of values with few owners, base ones
    among them) and n_copied (spans, shown or not, of values with more). owner is the column `source` unless given.
    Repeated rows and ids keep their rows, a row without spans has an empty string, an empty table gives an empty table.
    """
    base = written(scan(docs, F.col("source") if owner is None else owner, id=id, text=text, bits=bits), paths)
    found = base.where(F.size("spans") > 0).select("at", "owner", "repository", F.explode("spans").alias("s")).select("at", "owner", "repository", "s.*")
    known = written(ownership(found).withColumn("live", F.col("n_owners") <= most_owners), paths)
    # values with a thousandth of all spans or more are a thousand at most: they go to the tasks, the others are shuffled
    total = known.agg(F.sum("n_spans")).first()[0] or 0
    often = known.where(F.col("n_spans") * 1000 >= total).select("value", F.col("live").alias("often_live"))
    met = found.drop("owner", "repository").join(F.broadcast(often), "value", "left")
    rare = met.where("often_live is null").drop("often_live").join(known.select("value", "live"), "value")
    judged = met.where("often_live is not null").withColumnRenamed("often_live", "live").unionByName(rare)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.when((F.col("kind") < 3) | F.col("live"), F.struct("start", "kind", F.concat_ws(":", kind, "start", "end").alias("span")))
    # what one text holds
    by_row = judged.groupBy("at").agg(F.sort_array(F.collect_list(span)).alias("all"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"))
    by_row = by_row.select("at", F.array_join(F.transform("all", lambda s: s["span"]), ",").alias("all"), "n_live", "n_copied")
    none = F.lit(0).cast("long")
    return base.join(by_row, "at", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("all", F.lit("")).alias("spans"), F.coalesce("n_live", none).alias("n_live"), F.coalesce("n_copied", none).alias("n_copied")
    )


def op13(docs: DataFrame) -> DataFrame:
    """The query's rows: owners are sources; edge cases as stated at `secrets`."""
    return secrets(docs)
