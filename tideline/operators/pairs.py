"""Counts of two feeds side by side per symbol and window, and their correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.numeric import guarded_correlation
from tideline.operators.windowed import window_agg

SIDES = ("warnings", "tweets")


def resolve_one_sided(pairs: DataFrame, one_sided: str) -> DataFrame:
    """Treat symbols that have only one of the two counts (see :func:`count_pairs`)."""
    a, b = SIDES
    if one_sided == "zero":
        return pairs
    if one_sided == "inner":
        return pairs.where((F.col(a) > 0) & (F.col(b) > 0))
    if one_sided == "mirror":
        rest = [c for c in pairs.columns if c not in SIDES]
        return pairs.select(
            *rest,
            F.when(F.col(a) > 0, F.col(a)).otherwise(F.col(b)).alias(a),
            F.when(F.col(b) > 0, F.col(b)).otherwise(F.col(a)).alias(b),
        )
    raise ValueError(f"one_sided must be mirror, zero or inner, not {one_sided!r}")


def count_pairs(
    warnings: DataFrame, mentions: DataFrame, window: str | Column, one_sided: str = "mirror"
) -> DataFrame:
    """Warnings and mentions per (window, symbol), counted from the raw rows.

    Both sides are tagged, put together and grouped once, so there is a single
    shuffle of partial counts. A symbol seen on one side only is mirrored
    (both counts equal), completed with ``zero``, or left out (``inner``).
    """
    tagged = warnings.select("symbol", "event_time", F.lit(True).alias("_w")).unionByName(
        mentions.select("symbol", "event_time", F.lit(False).alias("_w"))
    )
    pairs = window_agg(
        tagged, window, ["symbol"],
        F.count_if("_w").alias(SIDES[0]), F.count_if(~F.col("_w")).alias(SIDES[1]),
    )
    return resolve_one_sided(pairs, one_sided)


def cogroup_counts(
    warnings: DataFrame, tweets: DataFrame, one_sided: str = "mirror"
) -> DataFrame:
    """As :func:`count_pairs`, from counts that are already one row per window and symbol."""
    key = ["window_start", "window_end", "symbol"]
    a, b = SIDES
    tagged = warnings.select(*key, F.col("count").alias(a), F.lit(0).cast("bigint").alias(b)).unionByName(
        tweets.select(*key, F.lit(0).cast("bigint").alias(a), F.col("count").alias(b))
    )
    return resolve_one_sided(tagged.groupBy(*key).agg(F.sum(a).alias(a), F.sum(b).alias(b)), one_sided)


def join_counts(warnings: DataFrame, tweets: DataFrame) -> DataFrame:
    """Inner join of two per-window counts on window and symbol."""
    key = ["window_start", "window_end", "symbol"]
    a, b = SIDES
    left = warnings.select(*key, F.col("count").alias(a))
    return left.join(tweets.select(*key, F.col("count").alias(b)), key, "inner")


def correlation_by_window(pairs: DataFrame, x: str = SIDES[0], y: str = SIDES[1]) -> DataFrame:
    """Population correlation of the two counts over the symbols of each window."""
    return pairs.groupBy("window_start", "window_end").agg(
        guarded_correlation(x, y).alias("correlation")
    )
