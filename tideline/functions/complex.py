"""Arithmetic on complex columns, structs of ``re`` and ``im``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complex_of(re: str | Column, im: str | Column = None) -> Column:
    """Complex number from its parts; a real one where ``im`` is left out."""
    re = F.col(re) if isinstance(re, str) else re
    im = F.lit(0.0) if im is None else (F.col(im) if isinstance(im, str) else im)
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def _parts(c: str | Column) -> tuple[Column, Column]:
    c = F.col(c) if isinstance(c, str) else c
    return c.getField("re"), c.getField("im")


def plus(a: str | Column, b: str | Column) -> Column:
    (ar, ai), (br, bi) = _parts(a), _parts(b)
    return complex_of(ar + br, ai + bi)


def minus(a: str | Column, b: str | Column) -> Column:
    (ar, ai), (br, bi) = _parts(a), _parts(b)
    return complex_of(ar - br, ai - bi)


def times(a: str | Column, b: str | Column) -> Column:
    (ar, ai), (br, bi) = _parts(a), _parts(b)
    return complex_of(ar * br - ai * bi, ar * bi + ai * br)


def scaled(a: str | Column, factor: float | Column) -> Column:
    re, im = _parts(a)
    return complex_of(re * factor, im * factor)


def divided(a: str | Column, divisor: float | Column) -> Column:
    re, im = _parts(a)
    return complex_of(re / divisor, im / divisor)


def exponential(a: str | Column) -> Column:
    re, im = _parts(a)
    return complex_of(F.exp(re) * F.cos(im), F.exp(re) * F.sin(im))


def complex_text(re: str | Column, im: str | Column) -> Column:
    """Complex number as text with three decimals, such as ``1.500 - 0.250i``.

    A part that is written as 0.000 is left out, unless both are; the sign of the
    imaginary part is only written after a real part.
    """
    real = F.format_string("%1.3f", F.col(re) if isinstance(re, str) else re)
    height = F.col(im) if isinstance(im, str) else im
    size = F.format_string("%1.3f", F.abs(height))
    has_real, has_imaginary = real != "0.000", size != "0.000"
    sign = F.when(has_real, F.when(height > 0, " + ").otherwise(" - ")).otherwise("")
    return F.concat(
        F.when(has_imaginary & ~has_real, "").otherwise(real),
        F.when(~has_imaginary, "").otherwise(F.concat(sign, size, F.lit("i"))),
    )
