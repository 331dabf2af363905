"""Warnings, count pairs, delta trigger and evictor, with and without hot keys."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import delta, ordered, pairs
from tideline.plans import stocks

T0 = 1_704_067_200_000
SPLIT = [1_000_000, 40, 7]


def prices(spark, rows):
    """(symbol, price, millisecond, arrival)"""
    df = spark.createDataFrame(rows, "symbol string, price double, ts_ms bigint, arrival bigint")
    return df.withColumn("event_time", F.timestamp_millis(F.lit(T0) + F.col("ts_ms")))


def series(kind, n, seed=1):
    rng, p, out = random.Random(seed), 100.0, []
    for i in range(n):
        if kind == "walk":
            p = max(1.0, p + rng.gauss(0, 2))
        elif kind == "rising":
            p *= 1.004
        elif kind == "flat":
            p = 100 + rng.random() * 4
        elif kind == "zeros":
            p = rng.choice([0.0, 0.0, 50.0, 51.0, 200.0])
        elif kind == "signed":
            p = rng.choice([-3.0, -1.0, 0.0, 1.0, 1.02, 3.0])
        out.append(round(p, 3))
    return out


def moved(old, new):
    return old != 0 if new == 0 else abs(old / new - 1) > 0.05


def fixture(spark, kind, n=300):
    rows, at = [], 0
    for i, p in enumerate(series(kind, n)):
        at += (i * 7919) % 50
        rows.append(("hot" if i % 5 else f"s{i % 3}", p, at, i * 3))
    return rows, prices(spark, rows)


def expected_triggers(rows, keep):
    refs, seen, out = {}, {}, []
    for sym, p, t, a in rows:
        seen.setdefault(sym, []).append((a, t))
        if sym not in refs:
            refs[sym] = p
        elif moved(refs[sym], p):
            refs[sym] = p
            out.append((sym, a, next(x for x, s in seen[sym] if s > t - keep)))
    return sorted(out)


@pytest.mark.parametrize("kind", ["walk", "rising", "flat", "zeros", "signed"])
@pytest.mark.parametrize("max_rows", SPLIT)
def test_delta_trigger_and_evictor(spark, kind, max_rows):
    rows, df = fixture(spark, kind)
    want = expected_triggers(rows, 120)
    fired = delta.delta_trigger(df, ["symbol"], max_rows=max_rows)
    assert sorted((r.symbol, r.arrival) for r in fired.collect()) == [w[:2] for w in want]
    if kind == "walk":
        first = delta.evicted_delta_trigger(df, ["symbol"], 120, max_rows=max_rows)
        assert sorted((r.symbol, r.arrival, r.first_arrival) for r in first.collect()) == want


@pytest.mark.parametrize("max_rows", SPLIT)
def test_neighbours_and_index(spark, max_rows):
    rows, df = fixture(spark, "walk")
    by = {}
    for sym, p, t, a in rows:
        by.setdefault(sym, []).append(a)
    nxt = ordered.with_next(df, ["symbol"], "arrival", {"n": "arrival"}, max_rows)
    prv = ordered.with_previous(df, ["symbol"], "arrival", {"n": "arrival"}, max_rows)
    idx = ordered.with_index(df, ["symbol"], "arrival", max_rows=max_rows)
    for frame, shift in ((nxt, 1), (prv, -1)):
        for r in frame.collect():
            at = by[r.symbol].index(r.arrival) + shift
            assert r.n == (by[r.symbol][at] if 0 <= at < len(by[r.symbol]) else None)
    for r in idx.collect():
        assert (r.idx, r.n) == (by[r.symbol].index(r.arrival), len(by[r.symbol]))


def test_a_hot_key_is_cut_and_null_keys_are_kept(spark):
    rows = [(None, 1.0, i, i) for i in range(200)] + [("a", 1.0, 0, 1000)]
    df = prices(spark, rows)
    cells = ordered.cut(df, ["symbol"], "arrival", 20)
    sizes = [r["count"] for r in cells.of(df).groupBy(*cells.by).count().collect()]
    assert sum(sizes) == 201 and max(sizes) <= 30
    nxt = ordered.with_next(df, ["symbol"], "arrival", {"n": "arrival"}, 20)
    assert sorted(r.n for r in nxt.where("symbol is null and n is not null").collect()) == list(range(1, 200))


def test_one_warning_stamped_with_the_older_row(spark):
    df = prices(spark, [("s", p, i, i) for i, p in enumerate((100.0, 105.0, 105.2, 111.0))])
    assert [(r.price, r.arrival) for r in delta.price_warnings(df, "1 day").collect()] == [(105.2, 2)]
    assert delta.price_warnings(df.limit(1), "1 day").count() == 0
    custom = delta.price_warnings(df, "1 day", changed=lambda old, new: F.col(new) > F.col(old) + 4)
    assert {r.arrival for r in custom.collect()} == {0, 2}


@pytest.mark.parametrize("max_rows", SPLIT)
def test_warnings_stay_inside_the_window(spark, max_rows):
    rows, df = fixture(spark, "walk", 200)
    got = delta.price_warnings(df, "1 second", max_rows=max_rows)
    last, want = {}, []
    for sym, p, t, a in rows:
        key = (sym, t // 1000)
        if key in last and moved(last[key][0], p):
            want.append((sym, last[key][1]))
        last[key] = (p, a)
    assert sorted((r.symbol, r.arrival) for r in got.collect()) == sorted(want)


def sides(spark):
    warn = prices(spark, [("a", 0.0, 0, 0), ("a", 0.0, 1, 1), ("w", 0.0, 2, 2), ("w", 0.0, 3, 3)])
    seen = prices(spark, [("a", 0.0, 4, 4), ("m", 0.0, 5, 5)])
    return warn, seen


@pytest.mark.parametrize("mode, want", [
    ("mirror", {("a", 2, 1), ("w", 2, 2), ("m", 1, 1)}),
    ("zero", {("a", 2, 1), ("w", 2, 0), ("m", 0, 1)}),
    ("inner", {("a", 2, 1)}),
])
def test_one_sided_symbols(spark, mode, want):
    warn, seen = sides(spark)
    got = pairs.count_pairs(warn, seen, "1 day", mode)
    assert {(r.symbol, r.warnings, r.tweets) for r in got.collect()} == want
    a, b = stocks.count_per_symbol(warn, "1 day"), stocks.count_per_symbol(seen, "1 day")
    assert sorted(pairs.cogroup_counts(a, b, mode).collect()) == sorted(got.collect())
    if mode == "inner":
        assert sorted(pairs.join_counts(a, b).collect()) == sorted(got.collect())


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        pairs.count_pairs(*sides(spark), "1 day", "other")


def test_correlation_of_one_symbol_is_nan(spark):
    warn, seen = sides(spark)
    got = pairs.correlation_by_window(pairs.count_pairs(warn, seen, "1 day", "inner"))
    assert math.isnan(got.first().correlation)


@pytest.mark.parametrize("max_rows", [1000, 2])
def test_missing_prices_neither_fire_nor_become_the_reference(spark, max_rows):
    series = (None, float("nan"), 100.0, 111.0, None, float("nan"), 130.0, 131.0)
    df = prices(spark, [("s", p, i, i) for i, p in enumerate(series)])
    fired = delta.delta_trigger(df, ["symbol"], max_rows=max_rows)
    assert sorted(r.arrival for r in fired.collect()) == [3, 6]


def test_first_row_of_the_window_at_each_firing(spark):
    df = prices(spark, [("s", p, i, i) for i, p in enumerate((100.0, 101.0, 111.0, 90.0))])
    got = delta.first_of_fired(df, "1 second").collect()
    assert sorted((r.price, r.arrival, r.fired_arrival) for r in got) == [(100.0, 0, 2), (100.0, 0, 3)]
