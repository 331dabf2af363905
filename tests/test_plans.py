"""What the physical plans must look like to hold at scale."""

import pytest

from tideline.plans import catalog


def plan(spark, sf_dir, name):
    return catalog.all_queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, columns", [
    ("segment_speed", "l_suppkey,l_quantity,l_shipdate"),
    ("mentions_per_symbol", "ts,user_id,event_type"),
    ("elements_per_window", "ts"),
    ("late_classification", "event_id,ts"),
])
def test_scans_read_only_what_is_used(spark, sf_dir, name, columns):
    schema = plan(spark, sf_dir, name).split("ReadSchema: struct<")[1].split(">")[0]
    assert {part.split(":")[0] for part in schema.split(",")} == set(columns.split(","))


def test_filters_reach_the_scan(spark, sf_dir):
    assert "EqualTo(event_type,view)" in plan(spark, sf_dir, "mentions_per_symbol")
    assert "In(user_id, [11,3,7])" in plan(spark, sf_dir, "symbol_list_filter")


@pytest.mark.parametrize("name, shuffles", [
    ("segment_speed", 1), ("stopped_vehicles", 1), ("accidents", 2), ("toll_by_segment", 3),
    ("price_warnings", 1), ("mentions_per_symbol", 1), ("count_pairs_mirror", 2),
    ("correlation_by_window", 3), ("delta_trigger", 1), ("window_delta_trigger", 1),
    ("counter_rates", 1), ("pane_counts", 1), ("stock_lines", 0),
    ("fan_out", 0), ("sliding_mean", 2), ("top_bigrams", 2), ("running_total", 2),
])
def test_number_of_shuffles(spark, sf_dir, name, shuffles):
    text = plan(spark, sf_dir, name)
    assert text.count("Exchange hashpartitioning") == shuffles
    assert "SinglePartition" not in text


@pytest.mark.parametrize("name", [
    "segment_speed", "stopped_vehicles", "accidents", "toll_by_segment", "count_pairs_mirror",
    "rolling_mean", "sliding_mean", "throughput", "bigram_counts", "pane_counts", "first_of_window",
])
def test_hash_aggregates_only(spark, sf_dir, name):
    assert "SortAggregate" not in plan(spark, sf_dir, name)


@pytest.mark.parametrize("name", [q for q in catalog.all_queries() if not q.startswith("stream_")])
def test_no_cross_join(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_short_signals_are_shuffled_once(spark, sf_dir):
    df = catalog.dft_by_window(spark, sf_dir)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1
