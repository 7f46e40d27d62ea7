"""Blocks of a number of integrations, on streams and tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "block long, first double, last double, integrations long, samples long, weight double, value double"
_STATE = "block long, closed double, times array<double>, sums array<double>, weights array<double>, samples array<long>"


def count_blocks(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, block, first, last, integrations, samples, weight, value): weighted means of blocks of ``n`` integrations, the distinct times of a key.

    rows: keys, time (a number), value, weight.  Blocks of a key are numbered in the
    order of time.  Rows with a null or NaN time, value or weight are left out, null
    keys form one key, and a block without weight has a null mean.

    On a table all blocks are given, a key's last one as full as it is; integrations
    are summed before they are numbered, so a key with most of the rows is spread
    over tasks.  On a stream (output mode ``append``) a block is given once a time
    beyond it has come, so the last stays open; the state of a key is the sums of
    ``n`` integrations.  A row that comes after its block was given joins none:
    such rows are given at once by their time, with a null block.
    """
    if n < 1:
        raise ValueError("a block holds one integration at least")
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    kept = rows.select(*keys, *map(number, ("time", "value", "weight"))).filter("time IS NOT NULL AND value IS NOT NULL AND weight IS NOT NULL")
    if rows.isStreaming:
        types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        ddl = ", ".join(f"`{k}` {types[k]}" for k in keys)
        return kept.groupBy(*keys).applyInPandasWithState(_closing(keys, n), f"{ddl}, {_OUT}", _STATE, "append", GroupStateTimeout.NoTimeout)
    each = kept.groupBy(*keys, "time").agg(F.sum(F.col("value") * F.col("weight")).alias("wv"), F.sum("weight").alias("w"), F.count("*").alias("n"))
    placed = each.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy("time")) - 1) / n))
    blocks = placed.groupBy(*keys, "block").agg(F.min("time").alias("first"), F.max("time").alias("last"), F.count("*").alias("integrations"), F.sum("n").alias("samples"), F.sum("w").alias("weight"), F.sum("wv").alias("wv"))
    return blocks.select(*keys, "block", "first", "last", "integrations", "samples", "weight", (F.col("wv") / F.nullif(F.col("weight"), F.lit(0.0))).alias("value"))


def _closing(keys: list[str], n: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block, closed, opened = 0, None, {}
        if state.exists:
            block, closed, times, *columns = state.get
            opened = {t: list(s) for t, *s in zip(times, *columns)}
        late: dict[float, list] = {}
        for rows in batches:
            rows = rows.assign(wv=rows["value"] * rows["weight"])
            for t, wv, w, count in rows.groupby("time").agg(wv=("wv", "sum"), w=("weight", "sum"), n=("wv", "size")).itertuples():
                sums = (opened if closed is None or t > closed else late).setdefault(t, [0.0, 0.0, 0])
                for i, v in enumerate((wv, w, count)):
                    sums[i] += v
        out = [_row(None, {t: s}) for t, s in sorted(late.items())]
        order = sorted(opened)
        while len(order) > n:
            out.append(_row(block, {t: opened.pop(t) for t in order[:n]}))
            closed, block, order = order[n - 1], block + 1, order[n:]
        state.update((block, closed, order, *([float(opened[t][i]) for t in order] for i in (0, 1)), [int(opened[t][2]) for t in order]))
        if out:
            names = [c.split()[0] for c in _OUT.split(", ")]
            yield pd.DataFrame([(*key, *r) for r in out], columns=[*keys, *names]).astype({"block": "Int64"})

    return run


def _row(block: int | None, times: dict[float, list]) -> tuple:
    wv, w, count = (sum(s[i] for s in times.values()) for i in range(3))
    return block, min(times), max(times), len(times), count, w, wv / w if w else None
