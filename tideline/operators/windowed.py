"""Windowed aggregates.

All are built-in partial aggregates: each map task sends at most one row per
(window, key), so a key that holds a large share of the rows costs no more than
any other. First/last rows are taken by an explicit ``arrival`` column; with a
BIGINT or TIMESTAMP arrival and fixed-width payload columns they stay hash
aggregates. Functions take ``keys`` as column names and return flat
``window_start`` / ``window_end`` columns where there is a window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.numeric import int_mean
from tideline.functions.windows import tumbling, window_bounds


# Groups a task of window_reduce holds before it hands them on.
MAX_HELD_GROUPS = 20_000


def window_agg(
    df: DataFrame, window: Column | str, keys: Sequence[str], *aggs: Column
) -> DataFrame:
    """Aggregates per (window, keys). ``window`` is a duration or a window column."""
    w = tumbling(window) if isinstance(window, str) else window
    return window_bounds(df.groupBy(w.alias("window"), *keys).agg(*aggs))


def window_count(df: DataFrame, window: Column | str, keys: Sequence[str] = ()) -> DataFrame:
    return window_agg(df, window, keys, F.count(F.lit(1)).alias("n"))


def window_sum(
    df: DataFrame, window: Column | str, keys: Sequence[str], value: str, name: str | None = None
) -> DataFrame:
    return window_agg(df, window, keys, F.sum(value).alias(name or value))


def mean_and_count(
    df: DataFrame, window: Column | str, keys: Sequence[str], value: str, mean: str, n: str = "n"
) -> DataFrame:
    """Integer mean of an integer column and the number of rows."""
    sums = window_agg(
        df, window, keys, F.sum(value).alias("_total"), F.count(F.lit(1)).alias(n)
    )
    return sums.withColumn(mean, int_mean("_total", n)).drop("_total")


def int_mean_first_text(
    df: DataFrame, keys: Sequence[str], value: str = "value", text: str = "text",
    arrival: str = "arrival", window: Column | str | None = None,
) -> DataFrame:
    """Integer mean per group, with the text that arrived first."""
    aggs = [
        F.min_by(text, arrival).alias(text),
        F.sum(value).alias("_total"),
        F.count(F.lit(1)).alias("n"),
    ]
    out = df.groupBy(*keys).agg(*aggs) if window is None else window_agg(df, window, keys, *aggs)
    return out.withColumn("mean_value", int_mean("_total", "n")).drop("_total")


def rolling_mean(
    df: DataFrame, window: Column | str, keys: Sequence[str], value: str = "price"
) -> DataFrame:
    """Mean per (window, keys), stamped with the last millisecond of the window."""
    out = window_agg(df, window, keys, F.avg(value).alias(value))
    return out.withColumn("ts", F.col("window_end") - F.expr("INTERVAL '0.001' SECOND"))


def sliding_mean(
    df: DataFrame, size: str, slide: str, keys: Sequence[str], value: str = "price"
) -> DataFrame:
    """Mean and count over sliding windows.

    Rows are summed first per greatest common part of size and slide, at whose
    borders all windows begin and end; only these partial sums are copied into the
    windows that overlap them, not the rows.
    """
    part = math.gcd(*[pd.Timedelta(span) // pd.Timedelta("1us") for span in (size, slide)])
    pane = df.groupBy(F.window("event_time", f"{part} microseconds").alias("_pane"), *keys).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_n")
    )
    stamped = pane.select(F.col("_pane.start").alias("event_time"), *keys, "_sum", "_n")
    out = window_agg(
        stamped, F.window("event_time", size, slide), keys,
        F.sum("_sum").alias("_sum"), F.sum("_n").alias("n"),
    )
    return out.withColumn(f"mean_{value}", F.col("_sum") / F.col("n")).drop("_sum")


def _row_by(
    df: DataFrame, window: Column | str | None, keys: Sequence[str], columns: Sequence[str],
    pick: Callable[[str], Column], *more: Column,
) -> DataFrame:
    aggs = [pick(c).alias(c) for c in columns] + list(more)
    if window is None:
        return df.groupBy(*keys).agg(*aggs)
    return window_agg(df, window, keys, *aggs)


def first_row(
    df: DataFrame, window: Column | str | None, keys: Sequence[str], columns: Sequence[str],
    arrival: str = "arrival", *more: Column,
) -> DataFrame:
    """The named columns of the row that arrived first in each group."""
    return _row_by(df, window, keys, columns, lambda c: F.min_by(c, arrival), *more)


def last_row(
    df: DataFrame, window: Column | str | None, keys: Sequence[str], columns: Sequence[str],
    arrival: str = "arrival", *more: Column,
) -> DataFrame:
    """The named columns of the row that arrived last in each group."""
    return _row_by(df, window, keys, columns, lambda c: F.max_by(c, arrival), *more)


def lowest_row(
    df: DataFrame, window: Column | str, keys: Sequence[str], columns: Sequence[str],
    value: str = "price", arrival: str = "arrival",
) -> DataFrame:
    """Row with the lowest value per group; of equal ones the first to arrive."""
    best = F.min(F.struct(value, arrival, *columns)).alias("_best")
    out = window_agg(df, window, keys, best)
    return out.select("window_start", "window_end", *keys, "_best.*")


def highest_row(
    df: DataFrame, window: Column | str, keys: Sequence[str], columns: Sequence[str],
    value: str = "price", arrival: str = "arrival",
) -> DataFrame:
    """Row with the highest value per group; of equal ones the first to arrive."""
    first_wins = (-F.col(arrival)).alias("_back")
    best = F.max(F.struct(F.col(value), first_wins, F.col(arrival), *columns)).alias("_best")
    out = window_agg(df, window, keys, best)
    return out.select("window_start", "window_end", *keys, "_best.*").drop("_back")


def top_k(
    df: DataFrame, k: int, within: Sequence[str], by: str = "n", ties: Sequence[str] = ()
) -> DataFrame:
    """The ``k`` highest rows of each group, with their ``rank``.

    Each task keeps its own best ``k`` rows before the shuffle, so a group may
    be of any size.
    """
    order = Window.partitionBy(*within).orderBy(F.col(by).desc(), *ties)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def throughput(df: DataFrame, every_seconds: int = 1, time: str = "event_time") -> DataFrame:
    """Rows per interval and whole rows per second."""
    out = window_agg(df, F.window(time, f"{every_seconds} seconds"), [], F.count(F.lit(1)).alias("n"))
    return out.withColumn("per_second", F.expr(f"n div {every_seconds}"))


def running_total(
    sums: DataFrame, keys: Sequence[str], order: str = "window_start", value: str = "total",
    name: str = "running",
) -> DataFrame:
    """Total over all windows of a key so far, from per-window sums.

    The input is already one row per (key, window), so a key has no more rows
    than there are windows, however many records it has.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn(name, F.sum(value).over(upto))


def window_reduce(
    df: DataFrame, window: Column | str, keys: Sequence[str], schema: T.StructType | str,
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    branches: int = 64,
) -> DataFrame:
    """Hook for a user-written associative aggregate per (window, keys).

    ``partial`` turns some rows of a group into one row of ``schema``, ``merge``
    turns several such rows into one. Rows are reduced inside each task before any
    shuffle; a group is then merged in ``branches`` parts and once
    more, so no task sees a whole group.
    """
    w = tumbling(window) if isinstance(window, str) else window
    flat = df.withColumn("_w", w).select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
        *df.columns,
    )
    by = ["window_start", "window_end", *keys]
    state = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    full = T.StructType([flat.schema[c] for c in by] + list(state.fields))
    names = list(full.names)

    def reduce_groups(fn):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            parts = []
            for key, group in pdf.groupby(by, sort=False, dropna=False):
                parts.append(fn(group).assign(**dict(zip(by, key))))
            return pd.concat(parts)[names] if parts else pd.DataFrame(columns=names)
        return run

    def map_side(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        first, again = reduce_groups(partial), reduce_groups(merge)
        held = None
        for pdf in batches:
            part = first(pdf)
            held = part if held is None else again(pd.concat([held, part]))
            if len(held) > MAX_HELD_GROUPS:
                yield held
                held = None
        if held is not None:
            yield held

    combined = flat.mapInPandas(map_side, full)
    branch = F.pmod(F.spark_partition_id(), F.lit(branches)).alias("_branch")
    halfway = combined.groupBy(*by, branch).applyInPandas(reduce_groups(merge), full)
    return halfway.groupBy(*by).applyInPandas(reduce_groups(merge), full)
