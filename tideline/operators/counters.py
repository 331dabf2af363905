"""Rates from cumulative counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.ordered import MAX_ROWS, with_previous


def counter_rates(
    samples: DataFrame, keys: Sequence[str], counters: Sequence[str], ts_ms: str = "ts_ms",
    order: str | None = None, max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Add ``<counter>_rate``: growth per whole second since the previous sample.

    Samples are taken by ``order`` (the time, where not given). The first sample
    of a key, and samples less than a second apart, rate 0.
    """
    previous = {f"_p_{c}": c for c in (ts_ms, *counters)}
    out = with_previous(samples, keys, order or ts_ms, previous, max_rows)
    seconds = F.expr(f"(`{ts_ms}` - `_p_{ts_ms}`) div 1000")
    out = out.withColumn("_seconds", seconds)
    for c in counters:
        rate = F.expr(f"(`{c}` - `_p_{c}`) div _seconds")
        out = out.withColumn(f"{c}_rate", F.when(F.col("_seconds") > 0, rate).otherwise(F.lit(0)))
    return out.drop("_seconds", *previous)
