"""Word n-gram counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import text as txt
from tideline.operators.windowed import window_agg


def ngram_counts(
    df: DataFrame, keys: Sequence[str] = (), n: int = 2, text: str = "text",
    window: str | Column | None = None,
) -> DataFrame:
    """How often each n-gram (of 2 up to ``n`` words) occurs per group."""
    keep = [*keys] if window is None else [*keys, "event_time"]
    split = df.select(*keep, txt.words(text).alias("_words"))
    grams = F.concat(*[txt.ngrams("_words", size) for size in range(2, n + 1)])
    rows = split.select(*keep, F.explode(grams).alias("ngram"))
    count = F.count(F.lit(1)).alias("n")
    if window is None:
        return rows.groupBy(*keys, "ngram").agg(count)
    return window_agg(rows, window, [*keys, "ngram"], count)
