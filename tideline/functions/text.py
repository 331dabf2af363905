"""Word, n-gram and padding columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: str | Column) -> Column:
    """Split on single blanks.

    Trailing empty words are dropped and interior ones kept; a text of blanks
    only has no words, the empty text has one empty word.
    """
    text = _col(text)
    trimmed = F.rtrim(text)
    blanks_only = (F.length(text) > 0) & (F.length(trimmed) == 0)
    return F.when(blanks_only, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, " ", -1)
    )


def ngrams(words: str | Column, n: int = 2) -> Column:
    """Word n-grams of an array of words, glued without a separator.

    Fewer than ``n`` words give one partial gram, no words give none. Pass a
    column name, so that the words are not split again for every gram.
    """
    w = _col(words)
    last_start = F.greatest(F.size(w) - n + 1, F.lit(1))
    grams = F.transform(
        F.sequence(F.lit(1), last_start),
        lambda i: F.array_join(F.slice(w, i, n), ""),
    )
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(grams)


def padded(text: str | Column, size: int, fill: str = "X") -> Column:
    """Text followed by one blank and ``size`` fill characters."""
    return F.concat(_col(text), F.lit(" "), F.repeat(F.lit(fill), F.lit(size)))


def without_padding(text: str | Column, size: int) -> Column:
    """Inverse of :func:`padded`: drop the last ``size + 1`` characters."""
    text = _col(text)
    return F.substring(text, F.lit(1), F.length(text) - (size + 1))
