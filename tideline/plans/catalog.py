"""The registered queries: every operator over the whole benchmark tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import complex as cx
from tideline.functions import text as txt
from tideline.functions.windows import epoch_ms
from tideline.operators import (
    counters,
    delta,
    lateness,
    ngrams,
    pairs,
    spectral,
    whole,
    windowed,
)
from tideline.plans import stocks, texts, tolls
from tideline.session import shared_dir
from tideline.sources import lines, metrics, sinks, tables
from tideline.streaming import native, panes, replay

Query = Callable[[SparkSession, str], DataFrame]

ROAD_WINDOW = "60 days"
PRICE_WINDOW = "1 day"
DAY_MS = 86_400_000
LATENESS_MS = 23 * tables.HOUR_MS

# Rows of far-future time that close all windows of a stream.
ROAD_END = {"l_shipdate": "2200-01-01"}
EVENT_END = {
    "ts": "2200-01-01", "event_id": -1, "user_id": -1, "value": 0.0, "event_type": "view",
}

_QUERIES: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _r6(c: str | Column) -> Column:
    # Adding zero turns a rounded -0.0 into 0.0.
    return F.round(c, 6) + F.lit(0.0)


def _zoneless(df: DataFrame) -> DataFrame:
    """Window bounds as zone-less timestamps, as the tables have them."""
    bounds = [c for c in ("window_start", "window_end", "event_time") if c in df.columns]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in bounds})


# -- roads -------------------------------------------------------------------


@_query
def segment_speed(spark, d):
    return tolls.segment_speed(tables.vehicles(spark, d), ROAD_WINDOW)


@_query
def stopped_vehicles(spark, d):
    return tolls.stopped_vehicles(tables.vehicles(spark, d), ROAD_WINDOW)


@_query
def stopped_vehicles_last(spark, d):
    return tolls.stopped_vehicles(tables.vehicles(spark, d), ROAD_WINDOW, keep="last")


@_query
def accidents(spark, d):
    return tolls.accidents(tables.vehicles(spark, d), ROAD_WINDOW)


@_query
def toll_by_segment(spark, d):
    return tolls.tolls(tables.vehicles(spark, d), ROAD_WINDOW)


@_query
def toll_from_parts(spark, d):
    reports = tables.vehicles(spark, d)
    return tolls.tolls_from_parts(
        tolls.segment_speed(reports, ROAD_WINDOW), tolls.accidents(reports, ROAD_WINDOW)
    )


@_query
def fan_out(spark, d):
    reports = tables.vehicles(spark, d).select("event_time", "speed", "abs_seg", "arrival")
    return lines.fan_out(reports, 3)


# -- prices and mentions -------------------------------------------------------


@_query
def price_warnings(spark, d):
    return delta.price_warnings(tables.prices(spark, d), PRICE_WINDOW)


@_query
def warnings_per_symbol(spark, d):
    return stocks.count_per_symbol(
        stocks.warnings(tables.prices(spark, d), PRICE_WINDOW), PRICE_WINDOW
    )


@_query
def mentions_per_symbol(spark, d):
    return stocks.count_per_symbol(tables.mentions(spark, d), PRICE_WINDOW)


def _pairs(spark, d, mode):
    return stocks.warning_mention_pairs(
        tables.prices(spark, d), tables.mentions(spark, d), PRICE_WINDOW, mode
    )


@_query
def count_pairs_mirror(spark, d):
    return _pairs(spark, d, "mirror")


@_query
def count_pairs_zero(spark, d):
    return _pairs(spark, d, "zero")


@_query
def count_pairs_inner(spark, d):
    return _pairs(spark, d, "inner")


@_query
def cogrouped_counts(spark, d):
    return pairs.cogroup_counts(
        warnings_per_symbol(spark, d), mentions_per_symbol(spark, d), "mirror"
    )


@_query
def joined_counts(spark, d):
    return pairs.join_counts(warnings_per_symbol(spark, d), mentions_per_symbol(spark, d))


@_query
def correlation_by_window(spark, d):
    out = stocks.warning_mention_correlation(
        tables.prices(spark, d), tables.mentions(spark, d), PRICE_WINDOW
    )
    return out.withColumn("correlation", _r6("correlation"))


@_query
def word_mentions(spark, d):
    texts = tables.utterances(spark, d).select("bucket", "text")
    return lines.symbol_mentions(texts).groupBy("bucket", "symbol").agg(
        F.count(F.lit(1)).alias("count")
    )


@_query
def symbol_filter(spark, d):
    listed = tables.table(spark, d, "supplier").where(F.col("s_acctbal") > 0).select(
        F.col("s_suppkey").alias("symbol")
    )
    return lines.only_symbols(tables.prices(spark, d), listed)


@_query
def symbol_list_filter(spark, d):
    return lines.only_symbols(tables.prices(spark, d), [3, 7, 11])


@_query
def union_feeds(spark, d):
    feeds = [
        tables.table(spark, d, "events")
        .where(F.col("event_type") == kind)
        .select(F.col("user_id").alias("symbol"), F.col("value").alias("price"))
        for kind in ("signup", "click", "view", "purchase", "error")
    ]
    parts = tables.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.col("l_extendedprice").alias("price")
    )
    return lines.union_feeds(*feeds, parts)


@_query
def rolling_mean(spark, d):
    out = windowed.rolling_mean(tables.prices(spark, d), PRICE_WINDOW, ["symbol"])
    return out.withColumn("price", _r6("price"))


@_query
def lowest_price(spark, d):
    return windowed.lowest_row(tables.prices(spark, d), PRICE_WINDOW, ["symbol"], [])


@_query
def highest_price(spark, d):
    return windowed.highest_row(tables.prices(spark, d), PRICE_WINDOW, ["symbol"], [])


@_query
def sliding_mean(spark, d):
    out = windowed.sliding_mean(tables.prices(spark, d), "1 day", "6 hours", ["symbol"])
    return out.withColumn("mean_price", _r6("mean_price"))


@_query
def sliding_mean_uneven(spark, d):
    """A size that is no multiple of the slide."""
    out = windowed.sliding_mean(tables.prices(spark, d), "10 hours", "4 hours", ["symbol"])
    return out.withColumn("mean_price", _r6("mean_price"))


@_query
def first_of_window(spark, d):
    return windowed.first_row(
        tables.prices(spark, d), PRICE_WINDOW, ["symbol"], ["price", "event_time"]
    )


@_query
def delta_trigger(spark, d):
    return delta.delta_trigger(tables.prices(spark, d), ["symbol"])


@_query
def window_delta_trigger(spark, d):
    flat = delta.with_window(tables.prices(spark, d), PRICE_WINDOW)
    return delta.delta_trigger(flat, ["symbol", "window_start", "window_end"])


@_query
def window_delta_first(spark, d):
    return delta.first_of_fired(tables.prices(spark, d), PRICE_WINDOW)


@_query
def evictor_delta(spark, d):
    prices = tables.prices(spark, d).withColumn("ts_ms", epoch_ms("event_time")).drop("event_time")
    return delta.evicted_delta_trigger(prices, ["symbol"], 6 * tables.HOUR_MS)


@_query
def absolute_delta_trigger(spark, d):
    """A delta function of the user's own: the absolute difference."""
    return whole.delta_trigger_where(tables.prices(spark, d), ["symbol"], lambda old, new: abs(old - new) > 25.0)


def _gaps(rows):
    """Median gap between the times of consecutive rows and longest run of rising prices."""
    gaps, n, run, longest, last = Counter(), 0, 0, 0, None
    for batch in rows:
        for ms, price in zip(batch.column("ts_ms").to_pylist(), batch.column("price").to_pylist()):
            run = run + 1 if last and price > last[1] else 1
            if last:
                gaps[ms - last[0]] += 1
            n, longest, last = n + 1, max(longest, run), (ms, price)
    middle, passed = [], 0
    for gap in sorted(gaps):
        passed += gaps[gap]
        middle += [gap] * sum(passed - gaps[gap] <= at < passed for at in {(n - 2) // 2, (n - 1) // 2})
    median = sum(middle) / len(middle) if middle else None
    kinds = {"n": pa.int64(), "median_gap_ms": pa.float64(), "longest_rise": pa.int64()}
    values = zip(kinds.items(), (n, median, longest))
    yield pa.RecordBatch.from_pydict({k: pa.array([v], kind) for (k, kind), v in values})


@_query
def gaps_by_window(spark, d):
    """The hook for user-written functions of a whole window."""
    ticks = tables.prices(spark, d).withColumn("ts_ms", epoch_ms("event_time"))
    schema = "n bigint, median_gap_ms double, longest_rise bigint"
    return whole.window_apply(ticks, PRICE_WINDOW, ["symbol"], "arrival", _gaps, schema)


# -- windowed functions on text and numbers --------------------------------------


@_query
def int_mean_by_bucket(spark, d):
    return windowed.int_mean_first_text(tables.utterances(spark, d), ["bucket"])


@_query
def elements_per_window(spark, d):
    return windowed.window_count(tables.prices(spark, d), PRICE_WINDOW)


@_query
def throughput(spark, d):
    return windowed.throughput(tables.prices(spark, d), 1)


@_query
def throughput_3s(spark, d):
    return windowed.throughput(tables.prices(spark, d), 3)


@_query
def running_total(spark, d):
    feed = tables.table(spark, d, "events").select(
        "event_type", "value", F.col("ts").alias("event_time")
    )
    daily = windowed.window_sum(feed, PRICE_WINDOW, ["event_type"], "value", "total")
    out = windowed.running_total(daily, ["event_type"])
    return out.withColumns({"total": _r6("total"), "running": _r6("running")})


@_query
def observed_counts(spark, d):
    """Rows per day next to the accumulators of the run that counted them."""
    seen_rows, seen = metrics.watched(
        tables.prices(spark, d),
        records=F.count(F.lit(1)), dear=F.count_if(F.col("price") > 50), newest=F.max("arrival"),
    )
    path = shared_dir(spark, "observed")
    windowed.window_count(seen_rows, PRICE_WINDOW).write.parquet(path)
    return spark.read.parquet(path).withColumns({k: F.lit(v).cast("bigint") for k, v in seen.get.items()})


@_query
def counter_rates(spark, d):
    samples = tables.table(spark, d, "events").select(
        F.col("event_type").alias("host"),
        epoch_ms("ts").alias("ts_ms"),
        (F.col("event_id") * 4096).alias("read_bytes"),
        (F.col("event_id") * 512).alias("write_bytes"),
        F.col("event_id").alias("arrival"),
    )
    return counters.counter_rates(samples, ["host"], ["read_bytes", "write_bytes"], order="arrival")


@_query
def squares_per_window(spark, d):
    """The hook for user-written associative aggregates."""
    import pandas as pd

    def partial(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(g)], "squares": [float((g["price"] ** 2).sum())]})

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [int(g["n"].sum())], "squares": [float(g["squares"].sum())]})

    out = windowed.window_reduce(
        tables.prices(spark, d), PRICE_WINDOW, [], "n bigint, squares double", partial, merge
    )
    return out.withColumn("squares", F.round("squares", 2))


@_query
def bigram_counts(spark, d):
    return ngrams.ngram_counts(tables.utterances(spark, d), ["bucket"])


@_query
def top_bigrams(spark, d):
    return windowed.top_k(bigram_counts(spark, d), 10, ["bucket"], ties=["ngram"])


def _spectrum(spark, d, inverse):
    out = spectral.dft(tables.samples(spark, d), ["event_type", "day"], inverse=inverse)
    # Two-decimal samples over n fall exactly between two roundings for many
    # bins; the small shift keeps the last digit from hanging on float noise.
    shifted = {c: _r6(F.col(c) + F.lit(1e-9)) for c in ("re", "im")}
    return out.withColumns(shifted)


@_query
def dft_by_window(spark, d):
    return _spectrum(spark, d, False)


@_query
def inverse_dft(spark, d):
    return _spectrum(spark, d, True)


@_query
def complex_numbers_as_text(spark, d):
    im = F.col("value") - F.floor(F.col("value")) - F.lit(0.5)
    re = F.when(F.col("event_id") % 3 == 0, F.lit(0.0)).otherwise(F.col("value"))
    return tables.table(spark, d, "events").select("event_id", cx.complex_text(re, im).alias("c"))


@_query
def complex_arithmetic(spark, d):
    a = cx.complex_of("value", F.col("user_id") / 8)
    b = cx.complex_of(F.col("user_id") / 4)
    out = tables.table(spark, d, "events").select(
        "event_id",
        cx.plus(a, b).alias("p"), cx.minus(a, b).alias("m"), cx.times(a, a).alias("t"),
        cx.scaled(a, 0.5).alias("s"), cx.divided(a, 4.0).alias("q"),
        cx.exponential(cx.scaled(a, 0.001)).alias("e"),
    )
    parts = [
        _r6(F.col(c).getField(part)).alias(f"{c}_{part}") for c in "pmtsqe" for part in ("re", "im")
    ]
    return out.select("event_id", *parts)


def _records(spark, d):
    return _records_of(tables.table(spark, d, "events"))


def _records_of(events):
    return events.select(
        F.concat_ws(" ", "event_type", F.col("user_id") % 10, "event_type").alias("text"),
        F.col("value").cast("int").alias("value"),
        F.col("ts").alias("event_time"),
        F.col("event_id").alias("arrival"),
    )


@_query
def mean_by_value(spark, d):
    return texts.windowed_function(_records(spark, d), PRICE_WINDOW, 0)


@_query
def bigrams_by_window(spark, d):
    return texts.windowed_function(_records(spark, d), PRICE_WINDOW, 1)


@_query
def spectrum_by_value(spark, d):
    out = texts.windowed_function(_records(spark, d), PRICE_WINDOW, 2)
    return out.withColumns({c: _r6(F.col(c) + F.lit(1e-9)) for c in ("re", "im")})


# -- late data -----------------------------------------------------------------


def _late(spark, d):
    feed = tables.late_feed(spark, d)
    watermark = lateness.periodic_watermark("arrival_ms", tables.HOUR_MS)
    return lateness.with_lateness(feed, DAY_MS, LATENESS_MS, watermark)


@_query
def late_classification(spark, d):
    return _late(spark, d).groupBy("lateness", "window_start_ms").agg(
        F.count(F.lit(1)).alias("n")
    )


@_query
def punctuated_watermark(spark, d):
    return lateness.punctuated_watermarks(tables.late_feed(spark, d), 2 * tables.HOUR_MS)


@_query
def pane_counts(spark, d):
    counts = lateness.pane_counts(_late(spark, d), ["key"], "value")
    return lateness.panes(counts).withColumn("total", _r6("total"))


@_query
def firing_log_rows(spark, d):
    fired = lateness.panes(lateness.pane_counts(_late(spark, d), ["key"], "value"))
    return _zoneless(sinks.firing_log(fired, DAY_MS))


@_query
def window_log_rows(spark, d):
    return sinks.window_log(windowed.window_count(tables.prices(spark, d), PRICE_WINDOW))


@_query
def skewed_event_time(spark, d):
    feed = tables.table(spark, d, "events").select("event_id", epoch_ms("ts").alias("ts_ms"))
    spread = F.col("event_id") % F.lit(1 << 31) * F.lit(2654435761) % F.lit(1 << 32)
    return lateness.with_skew(feed, DAY_MS, 3, uniform=spread / F.lit(float(1 << 32)))


# -- line feeds ------------------------------------------------------------------


def _event_lines(spark, d, *parts):
    return tables.table(spark, d, "events").select(
        F.col("event_id").alias("arrival"), F.concat_ws(" ", *parts).alias("value")
    )


@_query
def stock_lines(spark, d):
    feed = _event_lines(spark, d, F.concat(F.lit("SYM"), "user_id"), "value", epoch_ms("ts"))
    return _zoneless(lines.stock_prices(feed))


@_query
def stock_lines_permissive(spark, d):
    price = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    feed = _event_lines(spark, d, F.concat(F.lit("SYM"), "user_id"), price, epoch_ms("ts"))
    return _zoneless(lines.stock_prices(feed, permissive=True))


@_query
def tweet_lines(spark, d):
    feed = _event_lines(spark, d, F.concat(F.lit("sym"), "user_id"), "event_type", epoch_ms("ts"))
    mentions = lines.symbol_mentions(lines.tweets(feed))
    return _zoneless(stocks.count_per_symbol(mentions, PRICE_WINDOW))


@_query
def triple_lines(spark, d):
    return lines.triples(_event_lines(spark, d, "event_type", "user_id", "event_id"))


@_query
def vehicle_lines(spark, d):
    v = tables.vehicles(spark, d)
    unused = [F.lit(-1)] * 6
    feed = v.select(
        "arrival",
        F.concat_ws(
            ",", F.col("lane"), epoch_ms("event_time"), "car_id", "speed", F.lit(1), "lane",
            "dir", F.col("abs_seg"), "pos", *unused,
        ).alias("value"),
    )
    return _zoneless(lines.vehicle_reports(feed))


@_query
def text_lines(spark, d):
    feed = tables.table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("value"))
    padded = lines.texts(feed, padding=lines.TEXT_PADDING)
    return padded.select(
        "conv_id", "turn", F.length("text").alias("width"),
        txt.without_padding("text", lines.TEXT_PADDING).alias("text"), "value",
    )


# -- streams over the tables ------------------------------------------------------


@_query
def stream_two_panes(spark, d):
    """Late events replayed in three steps; panes as the watermark passes windows."""
    native.use_rocksdb(spark)
    feed = tables.late_feed(spark, d).select(
        "key", "value", F.timestamp_millis("ts_ms").alias("event_time"), "arrival"
    )
    count = feed.agg(F.max("arrival") + 1).scalar()
    step = (F.col("arrival") * 3 / count).cast("int")
    out = replay.replay(
        feed, step, 3, lambda s: panes.two_panes(s, ["key"], DAY_MS, LATENESS_MS, "value"),
        {"key": "", "value": 0.0, "event_time": "2200-01-01", "arrival": -1},
    )
    return out.withColumn("total", _r6("total"))


@_query
def stream_segment_speed(spark, d):
    native.use_rocksdb(spark)

    def job(lineitem):
        reports = tables.zoned(tables.vehicles_of(lineitem))
        return tolls.segment_speed(native.allow_late(reports, 60 * DAY_MS, 1), ROAD_WINDOW)

    return _zoneless(replay.once(tables.stream_table(spark, d, "lineitem"), job, ROAD_END))


@_query
def stream_tolls(spark, d):
    def job(lineitem):
        reports = tables.zoned(tables.vehicles_of(lineitem))
        return tolls.tolls(native.allow_late(reports, 60 * DAY_MS, 1), ROAD_WINDOW)

    native.use_rocksdb(spark)
    return _zoneless(replay.once(tables.stream_table(spark, d, "lineitem"), job, ROAD_END))


@_query
def stream_correlation(spark, d):
    def job(events):
        return stocks.correlation_stream(
            tables.zoned(tables.prices_of(events)), tables.zoned(tables.mentions_of(events)),
            DAY_MS, 1,
        )

    native.use_rocksdb(spark)
    out = replay.once(tables.stream_table(spark, d, "events"), job, EVENT_END)
    return _zoneless(out.withColumn("correlation", _r6("correlation")))


@_query
def stream_joined_counts(spark, d):
    def job(events):
        return stocks.joined_stream(
            tables.zoned(tables.prices_of(events)), tables.zoned(tables.mentions_of(events)), DAY_MS, 1
        )

    native.use_rocksdb(spark)
    return _zoneless(replay.once(tables.stream_table(spark, d, "events"), job, EVENT_END))


@_query
def stream_delta_trigger(spark, d):
    native.use_rocksdb(spark)
    return replay.once(
        tables.stream_table(spark, d, "events"),
        lambda events: panes.delta_stream(tables.prices_of(events), ["symbol"]),
    )


@_query
def stream_price_warnings(spark, d):
    def job(events):
        feed = tables.zoned(tables.prices_of(events))
        return panes.warning_stream(feed, DAY_MS, DAY_MS - 1)

    native.use_rocksdb(spark)
    return _zoneless(replay.once(tables.stream_table(spark, d, "events"), job))


def _stream_function(spark, d, complexity):
    def job(events):
        feed = native.allow_late(tables.zoned(_records_of(events)), DAY_MS, 1)
        return texts.windowed_function(feed, PRICE_WINDOW, complexity)

    native.use_rocksdb(spark)
    return _zoneless(replay.once(tables.stream_table(spark, d, "events"), job, EVENT_END))


@_query
def stream_mean_by_value(spark, d):
    return _stream_function(spark, d, 0)


@_query
def stream_bigrams(spark, d):
    return _stream_function(spark, d, 1)


@_query
def stream_lines_to_csv(spark, d):
    """Text files as a stream, parsed and appended to CSV files, which are read back."""
    base = shared_dir(spark, "lines")
    feed = _event_lines(spark, d, F.concat(F.lit("SYM"), "user_id"), "value", epoch_ms("ts"))
    sinks.dump_text(feed, f"{base}/in")
    prices = lines.stock_prices(lines.stream_lines(spark, f"{base}/in", max_files=8))
    sinks.bounded_run(sinks.append_csv(prices, f"{base}/out", f"{base}/state")).awaitTermination()
    return _zoneless(spark.read.schema(prices.schema).csv(f"{base}/out"))


def _totals_of(spark, d, job):
    native.use_rocksdb(spark)
    return replay.once(tables.stream_table(spark, d, "events"), lambda events: job(tables.zoned(_feed_of(events))))


def _feed_of(events):
    return events.select("event_type", "value", F.col("ts").alias("event_time"))


@_query
def stream_running_total(spark, d):
    """The last of the running totals of each key."""
    out = _totals_of(spark, d, lambda s: panes.running_totals(s, ["event_type"], "value", DAY_MS, "Append"))
    last = out.groupBy("event_type").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))
    return last.withColumn("total", _r6("total"))


@_query
def stream_processing_time(spark, d):
    """Windows of processing time, which differ from run to run, added up."""
    out = _totals_of(spark, d, lambda s: panes.processing_time_totals(s, ["event_type"], "value", 60_000))
    last = out.groupBy("event_type", "processed_ms").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))
    sums = last.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return sums.withColumn("total", _r6("total"))
