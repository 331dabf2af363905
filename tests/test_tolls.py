import pytest
from pyspark.sql import functions as F

from tideline.plans import tolls

W = "60 seconds"
T0 = 1_704_067_200_000


def reports(spark, rows):
    """(second, car, speed, seg, lane, pos, arrival)"""
    df = spark.createDataFrame(
        rows, "s bigint, car_id int, speed int, abs_seg int, lane int, pos int, arrival bigint"
    )
    return df.withColumn("event_time", F.timestamp_millis(F.lit(T0) + F.col("s") * 1000)).withColumn("dir", F.lit(0))


def standing(car, n, pos=7, seg=1):
    return [(i, car, 10 + i, seg, 0, pos, car * 100 + i) for i in range(n)]


def test_stopped_vehicles_and_accident(spark):
    df = reports(spark, standing(1, 4) + standing(2, 4) + standing(3, 3))
    first = tolls.stopped_vehicles(df, W).orderBy("car_id").collect()
    assert [(r.car_id, r.speed, r.n) for r in first] == [(1, 10, 4), (2, 10, 4)]
    last = tolls.stopped_vehicles(df, W, keep="last").collect()
    assert {r.speed for r in last} == {13}
    accident = tolls.accidents(df, W).collect()
    assert [(r.abs_seg, r.lane, r.pos, r.vehicles) for r in accident] == [(1, 0, 7, 2)]
    assert [r.toll for r in tolls.tolls(df, W).collect()] == [0.0]


def test_one_stopped_vehicle_is_no_accident(spark):
    assert tolls.accidents(reports(spark, standing(1, 9)), W).count() == 0


@pytest.mark.parametrize("n, speed, toll", [(50, 40, 0.0), (51, 40, 2.0), (52, 30, 8.0), (51, 41, 0.0)])
def test_toll_thresholds(spark, n, speed, toll):
    df = reports(spark, [(i % 60, i, speed, 5, 0, i, i) for i in range(n)])
    assert [r.toll for r in tolls.tolls(df, W).collect()] == [toll]
    parts = tolls.tolls_from_parts(tolls.segment_speed(df, W), tolls.accidents(df, W))
    assert [r.toll for r in parts.collect()] == [toll]


def test_an_accident_makes_the_segment_free(spark):
    moving = [(i % 60, 1000 + i, 20, 1, 1, 50 + i, 5000 + i) for i in range(60)]
    df = reports(spark, standing(1, 4) + standing(2, 5) + moving)
    assert [r.toll for r in tolls.tolls(df, W).collect()] == [0.0]
    without = tolls.tolls(reports(spark, standing(1, 4) + moving), W)
    assert [r.toll for r in without.collect()] == [2.0 * 14**2]


def test_mean_speed_is_an_integer_and_counts_reports(spark):
    df = reports(spark, [(0, 1, 10, 1, 0, 0, 0), (1, 1, 11, 1, 0, 0, 1), (61, 1, 30, 1, 0, 0, 2)])
    got = tolls.segment_speed(df, W).orderBy("window_start").collect()
    assert [(r.avg_speed, r.n) for r in got] == [(10, 2), (30, 1)]


def test_order_and_partitioning_do_not_matter(spark):
    df = reports(spark, standing(1, 4) + standing(2, 6) + standing(3, 5, pos=8))
    a = sorted(tolls.stopped_vehicles(df, W).collect())
    b = sorted(tolls.stopped_vehicles(df.orderBy(F.desc("arrival")).repartition(6), W).collect())
    assert a == b


def test_scan_reads_only_needed_columns_and_nothing_is_joined(spark, sf_dir):
    from tideline.plans import catalog

    plan = catalog.toll_by_segment(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "l_extendedprice" not in plan and "SortAggregate" not in plan
    assert plan.count("FileScan") == 1
