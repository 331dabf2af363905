"""Windowed functions over (text, value) records: mean, n-grams or spectrum."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tideline.operators.delta import with_window
from tideline.operators.ngrams import ngram_counts
from tideline.operators.spectral import dft
from tideline.operators.windowed import int_mean_first_text


def mean_by_value(records: DataFrame, window: str) -> DataFrame:
    """Integer mean per window and value, with the first text.

    Records are grouped by the value itself, so the mean equals the group.
    """
    keyed = records.withColumn("key", records["value"])
    return int_mean_first_text(keyed, ["key"], window=window)


def ngrams_by_window(records: DataFrame, window: str, n: int = 2) -> DataFrame:
    return ngram_counts(records, n=n, window=window)


def spectrum_by_value(records: DataFrame, window: str) -> DataFrame:
    """Transform of the values per window and value, labelled with the last text."""
    flat = with_window(records, window).withColumnRenamed("value", "key")
    keys = ["window_start", "window_end", "key"]
    return dft(flat.withColumn("value", flat["key"]), keys, label="text")


def windowed_function(records: DataFrame, window: str, complexity: int) -> DataFrame:
    """The function by its number: 0 mean, 1 n-grams, 2 spectrum.

    The first two also run on a stream with a watermark, in append mode.
    """
    return (mean_by_value, ngrams_by_window, spectrum_by_value)[complexity](records, window)
