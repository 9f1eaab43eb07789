"""Running counts, sums and hashes over the rows of each key in order, where a key may span many tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written


def running(df: DataFrame, key: str, order: Sequence[str], *, count: str | None = None, sums: Sequence[str] = (), xors: Sequence[str] = (), paths: list[str] | None = None) -> DataFrame:
    """Replace each column of `sums` and `xors` (long, no nulls) by its running value within the key, and add the running count.

    Rows are dealt by ranges of (key, order), nulls first, so that one key with a third of all rows is spread over as many
    tasks. Each task runs over its own range; what a key carries from one range to the next comes from the totals of
    those keys alone that end a range, at most two rows for each range, which are broadcast. The result is written.
    """
    columns = [(c, np.add) for c in sums] + [(c, np.bitwise_xor) for c in xors]
    n = count or "_n"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        last, held, values = None, 0, {c: 0 for c, _ in columns}
        for x in batches:
            if not len(x):
                continue
            k = x[key].to_numpy()
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(k)]))
            goes_on = last is not None and k[0] == last
            at = np.arange(len(k)) - first[group] + 1
            x[n] = at + np.where(group == 0, held if goes_on else 0, 0)
            for c, op in columns:
                v = op.accumulate(x[c].to_numpy(np.int64))
                before = np.r_[np.int64(0), v][first][group]
                v = v - before if op is np.add else v ^ before
                x[c] = np.where(group == 0, op(v, np.int64(values[c] if goes_on else 0)), v)
                values[c] = int(x[c].iloc[-1])
            last, held = k[-1], int(x[n].iloc[-1])
            yield x.assign(_range=part)

    schema = f"{df.schema.simpleString()[7:-1]},{n} bigint,_range int"
    local = written(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInPandas(run, schema), paths)
    edges = local.groupBy("_range").agg(F.max(key).alias(key)).select(key).distinct()
    totals = local.join(F.broadcast(edges), key).groupBy(key, "_range").agg(F.max(n).alias("_carried"), *[F.max_by(c, n).alias(f"_carried_{c}") for c, _ in columns])
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "_range", F.sum("_carried").over(before).alias("_carried"), *[(F.sum if op is np.add else F.bit_xor)(f"_carried_{c}").over(before).alias(f"_carried_{c}") for c, op in columns]).where("_carried is not null")
    out = local.join(F.broadcast(carried), [key, "_range"], "left")
    none = F.lit(0).cast("long")
    moved = {c: F.col(c) + F.coalesce(f"_carried_{c}", none) if op is np.add else F.col(c).bitwiseXOR(F.coalesce(f"_carried_{c}", none)) for c, op in columns}
    moved = {c: moved[c].alias(c) if c in moved else F.col(c) for c in df.columns}
    if count:
        moved[count] = (F.col(n) + F.coalesce("_carried", none)).alias(count)
    return out.select(*moved.values())
