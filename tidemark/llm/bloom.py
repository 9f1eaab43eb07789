"""A Bloom filter of bounded size over ids, built by tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of one chunk: what one bitmap of Spark's holds.
CHUNK = 1 << 15


def bloom_filter(ids: DataFrame, key: str = "doc_id", n: int | None = None, most: int = 1 << 29) -> np.ndarray:
    """Bytes over xxhash64 of the key: 16 bits and two probes for each id, 64 MB at most; n, if known, is at least their number.

    Beyond 2^25 ids it lets more and more through; callers treat what passes as a guess, so that costs work, never results.
    """
    n = ids.count() if n is None else n
    bits = 4 * CHUNK
    while bits < min(16 * n, most):
        bits *= 2
    h = F.xxhash64(key)
    places = ids.select(F.explode(F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits)))).alias("at"))
    places = places.select(F.floor(F.col("at") / CHUNK).cast("long").alias("chunk"), F.pmod("at", F.lit(CHUNK)).cast("long").alias("bit"))
    # dealt by chunk first, as maps from every task would outgrow the ids
    filled = places.repartition("chunk").groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((bits // CHUNK, CHUNK // 8), np.uint8)
    for r in filled.collect():  # 16,384 chunks of 4 KB at most
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def passes(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which xxhash64 values the filter lets through."""
    bits = np.int64(len(bloom) * 8)
    out = np.ones(len(h), bool)
    for at in (h % bits, (h.view(np.uint64) >> np.uint64(32)).astype(np.int64) % bits):
        out &= bloom[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1) == 1
    return out
