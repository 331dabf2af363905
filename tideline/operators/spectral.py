"""Discrete Fourier transform of the samples of each group.

Forward is ``sum x_j exp(+2 pi i jk / n)``, inverse is the same with the minus
sign and divided by ``n``; ``n`` is the number of samples filled up with zeros to
a power of two.

A group of up to ``max_points`` points is transformed in one piece. A longer one
is split as n = n1 * n2: samples with the same position modulo n2 are transformed
(n2 pieces of n1 points), turned, and regrouped by bin into n1 pieces of n2
points. Every piece is about sqrt(n) long, so no task holds a whole signal.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import complex as cx
from tideline.functions.numeric import next_power_of_two
from tideline.operators.ordered import CELL, MAX_ROWS, with_index

MAX_POINTS = 1 << 16
_PIECE = "re array<double>, im array<double>"


def _transform(inverse: bool):
    def one(at: np.ndarray, re: np.ndarray, im: np.ndarray, points: int) -> np.ndarray:
        signal = np.zeros(points, dtype=complex)
        signal[at] = re + 1j * np.asarray(im)
        # numpy's ifft has the plus sign; scaling is undone for the forward form.
        return np.fft.fft(signal) / points if inverse else np.fft.ifft(signal) * points

    @F.pandas_udf(_PIECE)
    def piece(at: pd.Series, re: pd.Series, im: pd.Series, points: pd.Series) -> pd.DataFrame:
        out = [one(*row) for row in zip(at, re, im, points)]
        return pd.DataFrame({"re": [z.real for z in out], "im": [z.imag for z in out]})

    return piece


def _pieces(
    rows: DataFrame, by: Sequence[str], at: str, points: str, inverse: bool, more: Sequence[str]
) -> DataFrame:
    """Transform the rows of each group; gives ``_bin``, ``re``, ``im`` and the greatest of ``more``."""
    lists = rows.groupBy(*by).agg(
        F.collect_list(F.struct(at, "re", "im")).alias("_s"), *[F.max(c).alias(c) for c in more]
    )
    bins = lists.select(*by, *more, _transform(inverse)(
        F.col(f"_s.{at}"), F.col("_s.re"), F.col("_s.im"), F.col(points)
    ).alias("_z"))
    zipped = F.arrays_zip(F.col("_z.re").alias("re"), F.col("_z.im").alias("im"))
    return bins.select(*by, *more, F.posexplode(zipped).alias("_bin", "_c")).select(
        *by, *more, F.col("_bin").cast("bigint").alias("_bin"), "_c.re", "_c.im"
    )


def dft(
    df: DataFrame, keys: Sequence[str], value: str = "value", order: str = "arrival",
    inverse: bool = False, imag: str | None = None, max_points: int = MAX_POINTS,
    max_rows: int = MAX_ROWS, label: str | None = None,
) -> DataFrame:
    """Columns ``bin, re, im, re_int`` of the transform of each group.

    ``order`` is the order of the samples, unique in a group. ``re_int`` is the
    real part cut to an integer after rounding off numerical noise, and kept
    inside the range of an integer. The last value of a ``label`` column comes
    along with each bin. A missing sample counts as zero, missing keys are a group.
    """
    im = F.lit(0.0) if imag is None else F.col(imag).cast("double")
    signal = df.select(
        *keys, order, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("re"), im.alias("im"),
        *([F.struct(order, label).alias("_label")] if label else []),
    )
    more = ["_label"] if label else []
    indexed = with_index(signal, keys, order, "_j", "_m", max_rows, keep_cell=True).withColumn(
        "_n", next_power_of_two("_m")
    )
    groups = [*keys, "_n"]

    # A short group lies in one cell; naming the cell saves a second shuffle.
    cell = [CELL] if CELL in indexed.columns and max_rows >= max_points else []
    short = _pieces(
        indexed.where(F.col("_n") <= max_points), [*groups, *cell], "_j", "_n", inverse, more
    )
    done = short.select(*keys, F.col("_bin").alias("bin"), "re", "im", *more)

    # n2 = 2^floor(bits / 2), n1 = n / n2
    bits = F.length(F.bin(F.col("_n"))) - 1
    n2 = F.pow(F.lit(2.0), F.floor(bits / 2)).cast("bigint")
    long = (
        indexed.where(F.col("_n") > max_points)
        .withColumn("_n2", n2)
        .withColumn("_n1", F.expr("_n div _n2"))
        .withColumn("_r", F.col("_j") % F.col("_n2"))
        .withColumn("_q", F.expr("_j div _n2"))
    )
    first = _pieces(long, [*groups, "_n1", "_n2", "_r"], "_q", "_n1", inverse, more)
    angle = F.lit(-2.0 if inverse else 2.0) * F.pi() * F.col("_r") * F.col("_bin") / F.col("_n")
    turned = first.withColumn(
        "_z", cx.times(cx.complex_of("re", "im"), cx.complex_of(F.cos(angle), F.sin(angle)))
    ).select(*groups, "_n1", "_n2", "_r", F.col("_bin").alias("_k1"), "_z.re", "_z.im", *more)
    second = _pieces(turned, [*groups, "_n1", "_n2", "_k1"], "_r", "_n2", inverse, more)
    merged = second.select(
        *keys, (F.col("_k1") + F.col("_n1") * F.col("_bin")).alias("bin"), "re", "im", *more
    )
    whole = F.greatest(F.lit(-(2.0**31)), F.least(F.round("re", 6), F.lit(2.0**31 - 1)))
    out = done.unionByName(merged).withColumn("re_int", whole.cast("int"))
    return out.withColumn(label, F.col("_label")[label]).drop("_label") if label else out


def last_text(df: DataFrame, keys: Sequence[str], text: str = "text", order: str = "arrival") -> DataFrame:
    """The text that arrived last in each group, as label of its transform."""
    return df.groupBy(*keys).agg(F.max_by(text, order).alias(text))

