import pandas as pd
"""Streams against hand-made panes and against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import delta
from tideline.operators.windowed import window_count
from tideline.plans import stocks, tolls
from tideline.streaming import native, panes, replay

T0 = 1_704_067_200_000
W = 10_000
LATE = 2 * W - 1


@pytest.fixture(scope="module")
def spark(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)


def feed(spark, steps):
    """One list of (key, millisecond) per step; the value is 1.0."""
    rows = [(k, 1.0, ms, i) for i, step in enumerate(steps) for k, ms in step]
    df = spark.createDataFrame(rows, "key string, value double, ms bigint, step int")
    return df.select("key", "value", F.timestamp_millis(F.lit(T0) + F.col("ms")).alias("event_time"), "step")


def run(spark, steps, job):
    out = replay.replay(feed(spark, steps), F.col("step"), len(steps), job)
    return sorted((r.key, r.window_start_ms - T0, r.pane, r.n) for r in out.collect())


LATE_STEPS = [
    [("k", 1000), ("k", 2000)],
    [("k", 12000)],
    [("k", 3000), ("k", 9000), ("j", 1000)],
    [("k", 50000)],
    [("k", 5000), ("k", 100000)],
]


def test_two_panes(spark):
    got = run(spark, LATE_STEPS, lambda s: panes.two_panes(s, ["key"], W, LATE, "value"))
    assert got == sorted([
        ("k", 0, "on_time", 2), ("k", 0, "final", 4), ("j", 0, "final", 1),
        ("k", 10000, "on_time", 1), ("k", 10000, "final", 1),
        ("k", 50000, "on_time", 1), ("k", 50000, "final", 1),
    ])


def test_late_row_in_the_batch_of_the_end_is_not_on_time(spark):
    # one batch per trigger without a pause in between: rows come before timers
    steps = [[("k", 1000)], [("k", 12000)], [("k", 3000), ("k", 100000)]]
    got = run(spark, steps, lambda s: panes.two_panes(s, ["key"], W, LATE, "value"))
    assert ("k", 0, "on_time", 1) in got and ("k", 0, "final", 2) in got


@pytest.mark.parametrize("accumulating, late", [(True, [3, 4]), (False, [1, 2])])
def test_early_and_late_panes(spark, accumulating, late):
    steps = [
        [("k", 1000)], [("k", 2000)], [("k", 12000)], [("k", 3000)], [("k", 4000)], [("k", 100000)],
    ]
    got = run(spark, steps, lambda s: panes.early_late_panes(
        s, ["key"], W, LATE, "value", early_ms=1, late_ms=1, accumulating=accumulating))
    assert got == sorted(
        [("k", 0, "early", 2), ("k", 0, "on_time", 2), ("k", 10000, "on_time", 1)]
        + [("k", 0, "late", n) for n in late]
    )


def test_no_period_means_no_early_or_late_panes(spark):
    got = run(spark, LATE_STEPS[:2] + LATE_STEPS[4:],
              lambda s: panes.early_late_panes(s, ["key"], W, LATE, "value", accumulating=True))
    assert got == [("k", 0, "on_time", 2), ("k", 10000, "on_time", 1)]


def native_counts(spark, marked):
    out = replay.replay(
        feed(spark, LATE_STEPS), F.col("step"), len(LATE_STEPS),
        lambda s: window_count(marked(s), f"{W} milliseconds", ["key"]),
    )
    ms = F.unix_millis("window_start") - T0
    return {(r.key, r.at): r.n for r in out.select("key", ms.alias("at"), "n").collect()}


def test_native_final_and_on_time_panes(spark):
    final = native_counts(spark, lambda s: native.allow_late(s, W, 2))
    assert final == {("k", 0): 4, ("j", 0): 1, ("k", 10000): 1, ("k", 50000): 1}
    on_time = native_counts(spark, native.on_time_only)
    assert on_time[("k", 0)] >= 2 and on_time[("k", 10000)] == 1


def price_feed(spark, n=120):
    rng, rows = random.Random(5), []
    for i in range(n):
        rows.append((f"s{i % 3}", round(100 + rng.gauss(0, 6), 2), T0 + i * 500, i))
    df = spark.createDataFrame(rows, "symbol string, price double, ts_ms bigint, arrival bigint")
    return df.withColumn("event_time", F.timestamp_millis("ts_ms"))


def test_delta_stream_equals_batch(spark):
    df = price_feed(spark)
    step = F.expr("cast(arrival div 60 as int)")
    got = replay.replay(df, step, 2, lambda s: panes.delta_stream(s, ["symbol"]))
    want = delta.delta_trigger(df, ["symbol"])
    assert sorted(r.arrival for r in got.collect()) == sorted(r.arrival for r in want.collect())

    windowed = delta.with_window(df, f"{W} milliseconds")
    want = delta.delta_trigger(windowed, ["symbol", "window_start"])
    got = replay.replay(df, step, 2, lambda s: panes.delta_stream(
        s, ["symbol"], window_ms=W, lateness_ms=LATE))
    assert sorted(r.arrival for r in got.collect()) == sorted(r.arrival for r in want.collect())


def test_warning_stream_equals_batch(spark):
    df = price_feed(spark)
    got = replay.replay(df, F.expr("cast(arrival div 50 as int)"), 3,
                        lambda s: panes.warning_stream(s, W, LATE))
    want = delta.price_warnings(df, f"{W} milliseconds")
    key = lambda r: (r.symbol, r.price, r.arrival, r.event_time)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_warning_stream_keeps_state_by_bucket(spark, tmp_path):
    """Not by symbol; missing and very large symbols stay apart, as in the batch."""
    rng, rows, big = random.Random(7), [], 1 << 60
    for i in range(900):
        symbol = [None, big, big + 1][i % 3] if i % 5 == 0 else i % 200
        price = [None, float("nan"), 0.0][i % 3] if i % 50 == 0 else round(100 + rng.gauss(0, 6), 2)
        rows.append((symbol, price, T0 + i * 20, i))
    df = spark.createDataFrame(rows, "symbol bigint, price double, ts_ms bigint, arrival bigint")
    df = df.withColumn("event_time", F.timestamp_millis("ts_ms"))
    for i in range(3):
        df.where(F.expr(f"arrival div 300 = {i}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        panes.warning_stream(stream, W, LATE, buckets=4).writeStream.format("memory")
        .queryName("warnings_out").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    want = delta.price_warnings(df, f"{W} milliseconds")
    key = lambda r: (r.symbol or -1, r.price, r.arrival, r.event_time)
    assert sorted(map(key, spark.table("warnings_out").collect())) == sorted(map(key, want.collect()))
    # two windows of four buckets and that of the missing symbol, with a timer each
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * 5 * 3


def test_running_totals(spark, tmp_path):
    df = feed(spark, LATE_STEPS)
    for i in (0, 2):
        df.where(F.col("step") == i).drop("step").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.drop("step").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        panes.running_totals(stream, ["key"], "value", W).writeStream.format("memory")
        .queryName("running_out").outputMode("update").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {(r.key, r.n) for r in spark.table("running_out").collect()}
    assert {("k", 2), ("k", 4), ("j", 1)} <= got


def test_tolls_stream_equals_batch(spark):
    rows = [(T0 + i * 100, i % 7, 20 + i % 9, 0, i % 3, i, i % 5) for i in range(400)]
    rows.append((T0 + 1_000_000, 99, 1, 9, 0, 400, 9))
    df = spark.createDataFrame(
        rows, "ms bigint, car_id int, speed int, lane int, pos int, arrival bigint, abs_seg int"
    ).withColumn("event_time", F.timestamp_millis("ms")).withColumn("dir", F.lit(0))
    span = f"{W} milliseconds"
    got = replay.replay(df, F.expr("cast(arrival div 201 as int)"), 2,
                        lambda s: tolls.tolls(native.allow_late(s, W, 2), span))
    want = tolls.tolls(df.where("abs_seg < 9"), span)
    assert sorted(got.collect()) == sorted(want.collect())


def test_correlation_stream_equals_batch(spark):
    df = price_feed(spark)
    last = spark.createDataFrame([("z", 1.0, T0 + 10_000_000, 124)], "symbol string, price double, ts_ms bigint, arrival bigint")
    df = df.unionByName(last.withColumn("event_time", F.timestamp_millis("ts_ms")))
    seen = lambda d: d.where(F.expr("arrival % 5 > arrival % 3")).select("symbol", "event_time")
    got = replay.replay(df, F.lit(0), 1,
                        lambda s: stocks.correlation_stream(s, seen(s), W, 1))
    want = stocks.warning_mention_correlation(df, seen(df), f"{W} milliseconds").where(
        F.col("window_start") < F.timestamp_millis(F.lit(T0 + 60_000)))
    a = {r.window_start: str(round(r.correlation, 9)) for r in got.collect()}
    b = {r.window_start: str(round(r.correlation, 9)) for r in want.collect()}
    assert a == b and len(a) == 6 and set(a.values()) != {"nan"}


def test_delta_scan_skips_missing_prices():
    class Cell:
        held = None

        def update(self, value):
            self.held = value

    scan = panes._DeltaScan(["price"], ["price"], "price", "arrival", 0.05, None)
    scan.cell = Cell()
    assert scan.visit(pd.DataFrame({"price": [float("nan")]}), None).empty
    assert scan.cell.held is None
    hits = scan.visit(pd.DataFrame({"price": [float("nan"), 100.0, 111.0, float("nan"), 130.0]}), None)
    assert hits["price"].tolist() == [111.0, 130.0] and scan.cell.held == (130.0,)
