"""Event-time window columns and lateness arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def tumbling(duration: str, event_time: str = "event_time") -> Column:
    """Tumbling window struct (start, end), aligned to the epoch."""
    return F.window(event_time, duration)


def sliding(duration: str, slide: str, event_time: str = "event_time") -> Column:
    """Sliding window struct; a row falls into ``duration / slide`` windows."""
    return F.window(event_time, duration, slide)


def window_bounds(df: DataFrame, window: str = "window") -> DataFrame:
    """Replace the window struct by flat ``window_start`` / ``window_end`` columns."""
    rest = [F.col(c) for c in df.columns if c != window]
    return df.select(
        F.col(f"{window}.start").alias("window_start"),
        F.col(f"{window}.end").alias("window_end"),
        *rest,
    )


def window_max_ts(window: str = "window") -> Column:
    """Last millisecond that belongs to the window."""
    return F.col(f"{window}.end") - F.expr("INTERVAL '0.001' SECOND")


def allowed_lateness_ms(window_ms: int, past_windows: int) -> int:
    """Lateness that keeps ``past_windows`` closed windows open for late rows."""
    return window_ms * past_windows - 1


def epoch_ms(ts: str | Column) -> Column:
    """Milliseconds since the epoch of a timestamp column (session zone UTC)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_millis(col.cast("timestamp"))
