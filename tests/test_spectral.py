import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tideline.operators.spectral import dft, last_text
from tideline.plans.texts import spectrum_by_value


def signal(spark, groups):
    rows = [(g, float(v), i * 2) for g, values in groups.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "g string, value double, arrival bigint")


def spectrum(df, **kw):
    out = {}
    for r in dft(df, ["g"], **kw).collect():
        out.setdefault(r.g, {})[r.bin] = complex(r.re, r.im)
    return {g: [b[i] for i in range(len(b))] for g, b in out.items()}


def test_three_samples_are_padded_to_four(spark):
    got = spectrum(signal(spark, {"x": [1, 2, 3]}))["x"]
    assert np.allclose(got, [6, -2 + 2j, 2, -2 - 2j])
    ints = dft(signal(spark, {"x": [1, 2, 3]}), ["g"]).orderBy("bin").collect()
    assert [r.re_int for r in ints] == [6, -2, 2, -2]


@pytest.mark.parametrize("max_points, max_rows", [(1 << 16, 10**6), (8, 10**6), (8, 10), (64, 10)])
@pytest.mark.parametrize("inverse", [False, True])
def test_split_transforms_equal_numpy(spark, max_points, max_rows, inverse):
    rng = random.Random(3)
    groups = {f"g{n}": [rng.gauss(0, 5) for _ in range(n)] for n in (1, 2, 8, 9, 33, 200)}
    got = spectrum(signal(spark, groups), inverse=inverse, max_points=max_points, max_rows=max_rows)
    for g, values in groups.items():
        n = 1 << (len(values) - 1).bit_length()
        x = np.zeros(n)
        x[: len(values)] = values
        want = np.fft.fft(x) / n if inverse else np.fft.ifft(x) * n
        assert np.allclose(got[g], want, atol=1e-9), g


def test_inverse_gives_the_input_back(spark):
    df = signal(spark, {"x": [3, 1, 4, 1, 5, 9, 2, 6]})
    there = dft(df, ["g"]).withColumnRenamed("bin", "at")
    back = dft(there, ["g"], value="re", imag="im", order="at", inverse=True).orderBy("bin").collect()
    assert np.allclose([r.re for r in back], [3, 1, 4, 1, 5, 9, 2, 6])
    assert np.allclose([r.im for r in back], 0)


def test_last_text(spark):
    df = spark.createDataFrame([("g", "a", 1), ("g", "b", 2)], "g string, text string, arrival bigint")
    assert last_text(df, ["g"]).first().text == "b"


def test_missing_values_keep_their_spectrum(spark):
    rows = [("a", None, 0), ("b", 3, 1), ("c", None, 2)]
    df = spark.createDataFrame(rows, "text string, value int, arrival bigint")
    df = df.withColumn("event_time", F.timestamp_millis("arrival"))
    got = {(r.key, r.bin): (r.text, r.re) for r in spectrum_by_value(df, "1 second").collect()}
    assert got == {(None, 0): ("c", 0.0), (None, 1): ("c", 0.0), (3, 0): ("b", 3.0)}
