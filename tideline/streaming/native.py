"""Windowed streams on Spark's own streaming aggregates.

Append mode with a watermark delay of the allowed lateness gives each window's
final pane; with a delay of zero it gives the on-time pane. Partial aggregation
happens before the shuffle, as in a batch job. Spark filters late rows by the
watermark of the batch before, so a final pane may hold rows of one batch more
than the exact rule of :mod:`tideline.streaming.panes` admits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.windows import allowed_lateness_ms
from tideline.session import ROCKSDB_PROVIDER


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state outside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def allow_late(
    df: DataFrame, window_ms: int, past_windows: int, event_time: str = "event_time"
) -> DataFrame:
    """Keep ``past_windows`` windows open for late rows."""
    delay = allowed_lateness_ms(window_ms, past_windows)
    return df.withWatermark(event_time, f"{delay} milliseconds")


def on_time_only(df: DataFrame, event_time: str = "event_time") -> DataFrame:
    """Close windows as soon as the watermark passes their end."""
    return df.withWatermark(event_time, "0 milliseconds")


def window_of(aggregated: DataFrame, duration: str, window: str = "window") -> Column:
    """Window column for a further aggregate over windows that have just closed."""
    return F.window(F.window_time(window), duration).alias(window)


def chained(
    aggregated: DataFrame, duration: str, keys: Sequence[str], *aggs: Column
) -> DataFrame:
    """Aggregate the closed windows of ``aggregated`` (with a ``window`` column) again."""
    return aggregated.groupBy(window_of(aggregated, duration), *keys).agg(*aggs)
