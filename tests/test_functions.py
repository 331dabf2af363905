import cmath
import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tideline.functions import complex as cx
from tideline.functions import numeric as num
from tideline.functions import text as txt
from tideline.functions import windows as win


@pytest.mark.parametrize("text, words", [
    ("a b c", ["a", "b", "c"]),
    ("a  b", ["a", "", "b"]),
    ("a b  ", ["a", "b"]),
    (" a", ["", "a"]),
    ("", [""]),
    ("   ", []),
])
def test_words(spark, text, words):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(txt.words("t")).first()[0] == words


@pytest.mark.parametrize("text, n, grams", [
    ("a b c", 2, ["ab", "bc"]),
    ("a", 2, ["a"]),
    ("a  b", 2, ["a", "b"]),
    ("   ", 2, []),
    ("a b c d", 3, ["abc", "bcd"]),
    ("a b", 3, ["ab"]),
])
def test_ngrams(spark, text, n, grams):
    df = spark.createDataFrame([(text,)], "t string").select(txt.words("t").alias("w"))
    assert df.select(txt.ngrams("w", n)).first()[0] == grams


def test_padding_round_trip(spark):
    df = spark.createDataFrame([("héllo",)], "t string").select(txt.padded("t", 7).alias("p"))
    row = df.select("p", txt.without_padding("p", 7).alias("t")).first()
    assert row.p == "héllo XXXXXXX" and row.t == "héllo"


@pytest.mark.parametrize("re, im, text", [
    (1.5, 0.0, "1.500"), (0.0, -2.0, "2.000i"), (1.0, 2.0, "1.000 + 2.000i"),
    (1.0, -2.0, "1.000 - 2.000i"), (0.0, 0.0, "0.000"),
])
def test_complex_text(spark, re, im, text):
    df = spark.createDataFrame([(re, im)], "re double, im double")
    assert df.select(cx.complex_text("re", "im")).first()[0] == text


@pytest.mark.parametrize("old, new, changed", [
    (100.0, 105.0, False), (105.0, 105.2, False), (105.2, 111.0, True),
    (95.0, 100.0, False), (1.0, 0.0, True), (0.0, 0.0, False), (0.0, 5.0, True),
])
def test_price_changed(spark, old, new, changed):
    df = spark.createDataFrame([(old, new)], "o double, n double")
    # 95 / 100 - 1 is a little more than 0.05 away in binary
    want = abs(old / new - 1) > 0.05 if new else changed
    assert df.select(num.price_changed("o", "n")).first()[0] is want


def test_int_mean_truncates(spark):
    df = spark.createDataFrame([(-7, 2), (7, 2)], "s bigint, n bigint")
    assert [r[0] for r in df.select(num.int_mean("s", "n")).collect()] == [-3, 3]


def test_next_power_of_two(spark):
    df = spark.range(1, 70).select("id", num.next_power_of_two("id").alias("p"))
    for r in df.collect():
        assert r.p == 1 << (r.id - 1).bit_length()


def test_correlation_of_constant_or_single_is_nan(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "x int, y int")
    assert math.isnan(df.agg(num.guarded_correlation("x", "y")).first()[0])
    assert math.isnan(df.limit(1).agg(num.guarded_correlation("x", "y")).first()[0])
    df = spark.createDataFrame([(1, 2), (2, 4), (3, 6)], "x int, y int")
    assert df.agg(num.guarded_correlation("x", "y")).first()[0] == pytest.approx(1.0)


def test_skew_follows_the_truncated_distribution(spark):
    u = num.hash_uniform("id")
    df = spark.range(40000).select(num.log_normal_steps(u, 3).alias("k"))
    share = {r.k: r["count"] / 40000 for r in df.groupBy("k").count().collect()}
    assert set(share) == {0, 1, 2, 3}
    # k steps: the log-normal variate rounds to k + 1; 0 also takes what rounds to 0
    below = [NormalDist().cdf(math.log(k + 1.5)) for k in range(4)]
    for k in range(4):
        want = (below[k] - (below[k - 1] if k else 0.0)) / below[3]
        assert share[k] == pytest.approx(want, abs=0.01)
    capped = spark.range(1000).select(num.log_normal_steps(u, 3, F.lit(1)).alias("k"))
    assert {r.k for r in capped.distinct().collect()} == {0, 1}


def test_skew_does_not_depend_on_partitioning(spark):
    k = num.log_normal_steps(num.hash_uniform("id"), 5).alias("k")
    a = {r.id: r.k for r in spark.range(500).select("id", k).collect()}
    b = {r.id: r.k for r in spark.range(500).repartition(7).select("id", k).collect()}
    assert a == b


def test_lateness_length():
    assert win.allowed_lateness_ms(10_000, 3) == 29_999


def test_window_columns(spark):
    df = spark.sql("select timestamp_ntz '2024-01-01 00:00:07' as event_time")
    w = df.select(win.tumbling("10 seconds").alias("window"))
    assert str(w.select(win.window_max_ts()).first()[0]) == "2024-01-01 00:00:09.999000"
    assert df.select(win.sliding("10 seconds", "5 seconds")).count() == 2


def test_complex_arithmetic(spark):
    a, b = complex(1.5, -2), complex(0.25, 3)
    df = spark.range(1).select(
        cx.complex_of(F.lit(a.real), F.lit(a.imag)).alias("a"),
        cx.complex_of(F.lit(b.real), F.lit(b.imag)).alias("b"),
    )
    row = df.select(
        cx.plus("a", "b"), cx.minus("a", "b"), cx.times("a", "b"), cx.scaled("a", 3.0),
        cx.divided("a", 4.0), cx.exponential("a"),
    ).first()
    want = [a + b, a - b, a * b, a * 3, a / 4, cmath.exp(a)]
    assert [complex(*z) for z in row] == pytest.approx(want)
