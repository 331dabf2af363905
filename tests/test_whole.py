"""Functions of whole windows, delta functions of the user's own and metrics of a run."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.operators.whole import delta_trigger_where, group_apply
from tideline.sources import lines, metrics, sinks


def fired_in_a_loop(rows, moved):
    last, out = {}, []
    for key, arrival, price in sorted(rows, key=lambda r: r[1]):
        if price is None or price != price:
            continue
        if key not in last:
            last[key] = price
        elif moved(last[key], price):
            out.append((key, arrival))
            last[key] = price
    return sorted(out, key=str)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_any_delta_function(spark, batch):
    """One key holds most rows and its groups run on over many batches."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.choice([None, float("nan")] + [rng.uniform(0, 100)] * 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "symbol string, arrival bigint, price double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = delta_trigger_where(df, ["symbol"], lambda a, b: abs(a - b) > 20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(((r.symbol, r.arrival) for r in got), key=str) == fired_in_a_loop(rows, lambda a, b: abs(a - b) > 20)


def test_groups_come_in_order_and_in_pieces(spark):
    rows = [(k, i) for k in (None, float("nan"), 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "k double, at int").repartition(4)

    def first_and_pieces(batches):
        first = next(batches).column("at")[0].as_py()
        yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int32())})

    def ordered(batches):
        seen = [x for b in batches for x in b.column("at").to_pylist()]
        yield pa.RecordBatch.from_pydict({"first": pa.array([seen[0] if seen == sorted(seen) else -1], pa.int32())})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for fn in (first_and_pieces, ordered):
            got = group_apply(df, ["k"], ["at"], fn, "first int").collect()
            assert sorted((str(r.k), r["first"]) for r in got) == [("1.0", 0), ("None", 0), ("nan", 0)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert group_apply(df.limit(0), ["k"], ["at"], ordered, "first int").collect() == []


def test_metrics_of_a_run_and_of_a_stream(spark, tmp_path):
    feed = spark.range(40).select(F.concat_ws(" ", F.lit("S"), "id", F.lit(1000)).alias("value"))
    seen_rows, seen = metrics.watched(feed, rows=F.count(F.lit(1)))
    for part in range(4):
        sinks.dump_text((seen_rows if part == 0 else feed).repartition(1), str(tmp_path / "in"))
    assert seen.get == {"rows": 40}
    prices = lines.stock_prices(lines.stream_lines(spark, str(tmp_path / "in"), max_files=1))
    counted = metrics.watched_stream(prices, "ticks", rows=F.count(F.lit(1)), paid=F.sum("price"))
    query = sinks.bounded_run(sinks.append_csv(counted, str(tmp_path / "out"), str(tmp_path / "state")))
    query.awaitTermination()
    assert metrics.stream_totals(query, "ticks") == {"rows": 160, "paid": 4 * sum(range(40))}
    assert spark.read.schema(prices.schema).csv(str(tmp_path / "out")).count() == 160
