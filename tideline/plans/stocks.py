"""Price-change warnings per symbol against symbol mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.numeric import guarded_correlation
from tideline.functions.windows import allowed_lateness_ms, window_bounds
from tideline.operators.delta import price_warnings
from tideline.operators.pairs import (
    SIDES,
    correlation_by_window,
    count_pairs,
    resolve_one_sided,
)
from tideline.operators.windowed import window_agg
from tideline.streaming.native import allow_late
from tideline.streaming.panes import warning_stream


def count_per_symbol(feed: DataFrame, window: str) -> DataFrame:
    """Rows per symbol and window as ``count``."""
    return window_agg(feed, window, ["symbol"], F.count(F.lit(1)).alias("count"))


def warnings(prices: DataFrame, window: str) -> DataFrame:
    """Warnings as a feed of their own: symbol and time of the older price."""
    return price_warnings(prices, window).select("symbol", "event_time")


def warning_mention_pairs(
    prices: DataFrame, mentions: DataFrame, window: str, one_sided: str = "mirror"
) -> DataFrame:
    return count_pairs(warnings(prices, window), mentions, window, one_sided)


def warning_mention_correlation(
    prices: DataFrame, mentions: DataFrame, window: str, one_sided: str = "mirror"
) -> DataFrame:
    """Correlation of warnings and mentions over the symbols of each window."""
    return correlation_by_window(warning_mention_pairs(prices, mentions, window, one_sided))


def pair_stream(
    prices: DataFrame, mentions: DataFrame, window_ms: int, past_windows: int,
    one_sided: str = "mirror",
) -> DataFrame:
    """Streaming warnings and mentions per ``window`` and symbol, in append mode."""
    lateness = allowed_lateness_ms(window_ms, past_windows)
    warned = warning_stream(prices, window_ms, lateness)
    tagged = warned.select("symbol", "event_time", F.lit(True).alias("_w")).unionByName(
        allow_late(mentions, window_ms, past_windows).select(
            "symbol", "event_time", F.lit(False).alias("_w")
        )
    )
    counts = tagged.groupBy(F.window("event_time", f"{window_ms} milliseconds"), "symbol").agg(
        F.count_if("_w").alias(SIDES[0]), F.count_if(~F.col("_w")).alias(SIDES[1])
    )
    return resolve_one_sided(counts, one_sided)


def correlation_stream(
    prices: DataFrame, mentions: DataFrame, window_ms: int, past_windows: int,
    one_sided: str = "mirror",
) -> DataFrame:
    """Streaming correlation of warnings and mentions per window, in append mode."""
    counts = pair_stream(prices, mentions, window_ms, past_windows, one_sided)
    out = counts.groupBy("window").agg(guarded_correlation(*SIDES).alias("correlation"))
    return window_bounds(out)


def joined_stream(
    prices: DataFrame, mentions: DataFrame, window_ms: int, past_windows: int
) -> DataFrame:
    """Streaming counts of warnings and mentions, joined per window and symbol.

    Two windowed counts, each in append mode, meet in an inner stream-stream join.
    The window carries the watermark, so the join's state holds open windows only.
    """
    warned = warning_stream(prices, window_ms, allowed_lateness_ms(window_ms, past_windows))
    feeds = zip(SIDES, (warned, allow_late(mentions, window_ms, past_windows)))
    by_window = F.window("event_time", f"{window_ms} milliseconds").alias("window")
    left, right = (
        feed.groupBy(by_window, "symbol").agg(F.count(F.lit(1)).alias(side)) for side, feed in feeds
    )
    return window_bounds(left.join(right, ["window", "symbol"], "inner"))
