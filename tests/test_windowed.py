from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import counters, lateness, ngrams, windowed

BASE = 1_704_067_200_000


def ticks(spark, rows):
    """(symbol, price, second, arrival)"""
    df = spark.createDataFrame(rows, "symbol string, price double, s bigint, arrival bigint")
    return df.withColumn("event_time", F.timestamp_millis(F.lit(BASE) + F.col("s") * 1000)).drop("s")


ROWS = [("a", 5.0, 0, 0), ("a", 3.0, 1, 1), ("a", 3.0, 2, 2), ("a", 9.0, 12, 3), ("b", 9.0, 3, 4), ("b", 9.0, 4, 5)]


def test_lowest_and_highest_take_the_first_of_equals(spark):
    df = ticks(spark, ROWS)
    low = windowed.lowest_row(df, "10 seconds", ["symbol"], [])
    assert {(r.symbol, r.price, r.arrival) for r in low.collect()} == {("a", 3.0, 1), ("a", 9.0, 3), ("b", 9.0, 4)}
    high = windowed.highest_row(df, "10 seconds", ["symbol"], ["event_time"])
    assert {(r.symbol, r.price, r.arrival) for r in high.collect()} == {("a", 5.0, 0), ("a", 9.0, 3), ("b", 9.0, 4)}


def test_first_and_last_row(spark):
    df = ticks(spark, ROWS)
    assert {r.price for r in windowed.first_row(df, None, ["symbol"], ["price"]).collect()} == {5.0, 9.0}
    last = windowed.last_row(df, "10 seconds", ["symbol"], ["price"])
    assert sorted((r.symbol, r.price) for r in last.collect()) == [("a", 3.0), ("a", 9.0), ("b", 9.0)]


def test_rolling_mean_is_stamped_with_the_last_millisecond(spark):
    row = windowed.rolling_mean(ticks(spark, ROWS), "10 seconds", ["symbol"]).where("symbol = 'b'").first()
    assert row.price == 9.0 and row.window_end - row.ts == timedelta(milliseconds=1)


def test_sliding_mean_equals_direct_windows(spark):
    df = ticks(spark, ROWS)
    got = windowed.sliding_mean(df, "10 seconds", "5 seconds", ["symbol"])
    want = windowed.window_agg(
        df, F.window("event_time", "10 seconds", "5 seconds"), ["symbol"],
        F.count("price").alias("n"), F.avg("price").alias("mean_price"),
    ).select(got.columns)
    assert sorted(got.collect()) == sorted(want.collect())


def test_int_mean_first_text(spark):
    df = spark.createDataFrame([("k", "y", 4, 1), ("k", "x", 3, 0)], "k string, text string, value int, arrival bigint")
    row = windowed.int_mean_first_text(df, ["k"]).first()
    assert (row.text, row.mean_value, row.n) == ("x", 3, 2)


def test_counts_sums_and_throughput(spark):
    df = ticks(spark, ROWS)
    assert sorted(r.n for r in windowed.window_count(df, "10 seconds").collect()) == [1, 5]
    assert sorted(r.price for r in windowed.window_sum(df, "10 seconds", [], "price").collect()) == [9.0, 29.0]
    got = windowed.throughput(df, 3).orderBy("window_start").collect()
    assert [(r.n, r.per_second) for r in got] == [(3, 1), (2, 0), (1, 0)]


def test_running_total(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 7.0)], "k string, window_start int, total double")
    got = windowed.running_total(df, ["k"]).collect()
    assert sorted((r.k, r.running) for r in got) == [("a", 2.0), ("a", 5.0), ("b", 7.0)]


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, i, i % 5) for i in range(50)], "g int, name int, n int")
    top = windowed.top_k(df, 3, ["g"], ties=["name"])
    assert [(r.name, r["rank"]) for r in top.orderBy("rank").collect()] == [(4, 1), (9, 2), (14, 3)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and ", Partial" in plan


def test_window_reduce(spark):
    df = ticks(spark, ROWS).repartition(5)

    def partial(g):
        return pd.DataFrame({"n": [len(g)], "top": [float(g["price"].max())]})

    def merge(g):
        return pd.DataFrame({"n": [int(g["n"].sum())], "top": [float(g["top"].max())]})

    got = windowed.window_reduce(df, "10 seconds", ["symbol"], "n bigint, top double", partial, merge, branches=2)
    assert sorted((r.symbol, r.n, r.top) for r in got.collect()) == [("a", 1, 9.0), ("a", 3, 5.0), ("b", 2, 9.0)]


def test_ngram_counts_per_window(spark):
    df = ticks(spark, [("a b a b", 0.0, 0, 0), ("a b", 0.0, 1, 1), ("a b", 0.0, 11, 2)])
    got = ngrams.ngram_counts(df.withColumnRenamed("symbol", "text"), window="10 seconds")
    assert sorted((r.ngram, r.n) for r in got.collect()) == [("ab", 1), ("ab", 3), ("ba", 1)]


@pytest.mark.parametrize("max_rows", [1000, 1])
def test_counter_rates(spark, max_rows):
    rows = [("h", 1000, 0), ("h", 3500, 900), ("h", 3900, 950), ("h", 5900, 1000)]
    df = spark.createDataFrame(rows, "host string, ts_ms bigint, bytes bigint")
    got = counters.counter_rates(df, ["host"], ["bytes"], max_rows=max_rows).orderBy("ts_ms")
    assert [r.bytes_rate for r in got.collect()] == [0, 450, 0, 25]


def test_lateness_classes_and_panes(spark):
    # window 10 s, lateness 5 s; watermark is the arrival time
    rows = [("k", 1, 5, 2.0), ("k", 2, 9999, 3.0), ("k", 3, 10000, 4.0), ("k", 4, 14998, 5.0), ("k", 5, 14999, 6.0)]
    df = spark.createDataFrame(rows, "key string, ts_ms bigint, arrival_ms bigint, value double")
    got = lateness.with_lateness(df, 10_000, 5_000, F.col("arrival_ms"))
    assert [r.lateness for r in got.orderBy("ts_ms").collect()] == ["on_time", "late", "late", "late", "dropped"]
    panes = lateness.panes(lateness.pane_counts(got, ["key"], "value")).collect()
    assert {(r.pane, r.n, r.total) for r in panes} == {("on_time", 1, 2.0), ("final", 4, 14.0)}
    only_late = lateness.panes(lateness.pane_counts(got.where("ts_ms > 1"), ["key"])).collect()
    assert [(r.pane, r.n) for r in only_late] == [("final", 3)]


def test_periodic_watermark(spark):
    df = spark.createDataFrame([(12345,)], "a bigint")
    assert df.select(lateness.periodic_watermark("a", 1000)).first()[0] == 12000


def test_with_skew_moves_back_by_whole_steps(spark):
    df = spark.range(200).withColumn("ts_ms", F.col("id") * 1000)
    got = lateness.with_skew(df, 500, 3).select(((F.col("ts_ms") - F.col("event_ms")) / 500).alias("k"))
    assert {r.k for r in got.collect()} <= {0.0, 1.0, 2.0, 3.0}
