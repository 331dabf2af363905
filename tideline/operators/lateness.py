"""Late data: skewed event times, wall-clock watermarks, on-time and final panes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numeric import hash_uniform, log_normal_steps

ON_TIME, LATE, DROPPED, FINAL = "on_time", "late", "dropped", "final"


def with_skew(
    df: DataFrame, step_ms: int, max_steps: int, time_ms: str = "ts_ms", out: str = "event_ms",
    uniform: str | Column | None = None, seed: int = 100, cap: Column | None = None,
) -> DataFrame:
    """Set event times back by a random whole number of steps.

    The number of steps is a truncated log-normal variate of a hash of the
    row's time (or of ``uniform``), so a re-run or another partitioning gives
    the same times. ``cap`` may lower the limit per row, as at the start of a
    feed when fewer windows have passed.
    """
    u = hash_uniform(time_ms, seed=seed) if uniform is None else uniform
    steps = log_normal_steps(u, max_steps, cap)
    return df.withColumn(out, F.col(time_ms) - steps * F.lit(step_ms))


def periodic_watermark(arrival_ms: str | Column, interval_ms: int) -> Column:
    """Wall-clock watermark in force at an arrival: the last whole interval."""
    arrival = F.col(arrival_ms) if isinstance(arrival_ms, str) else arrival_ms
    return arrival - F.pmod(arrival, F.lit(interval_ms))


def punctuated_watermarks(
    df: DataFrame, slide_ms: int, arrival: str = "arrival", clock_ms: str = "arrival_ms",
    time_ms: str = "ts_ms",
) -> DataFrame:
    """(arrival, watermark_ms, boundary_ms): the rows that move a punctuated watermark.

    A boundary stands at the end of the first arrival's slide. A row of later event
    time moves the watermark to its own time and the boundary to the end of its own
    slide; a row on the boundary does not.

    In slides, a row of time e needs a boundary below ceil(e) and sets floor(e) + 1,
    which is one more than ceil(e) only where e ends a slide. So the boundary is
    always the largest ceil(e) so far or one more, and only the first row of each new
    largest can move it. That leaves a row a slide, combined before the shuffle; they
    are put in order by one task, which holds as many rows as the feed has slides.
    After a row that ends a slide, a row of the very next slide does not fire: along
    a run of such rows every second one does.

    Rows with a null arrival, clock or time take no part; of rows with one arrival
    number the one of least time comes first. No rows give no watermark.
    """
    slide = F.lit(slide_ms).cast("bigint")
    below = F.floor(F.col(time_ms) / slide).cast("bigint")
    exact = F.pmod(F.col(time_ms), slide) == 0
    known = df.where(F.col(arrival).isNotNull() & F.col(clock_ms).isNotNull() & F.col(time_ms).isNotNull())
    firsts = known.groupBy(F.when(exact, below).otherwise(below + 1).alias("level")).agg(
        F.min(F.struct(F.col(arrival).alias("at"), F.col(time_ms).alias("time"), F.col(clock_ms).alias("clock"))).alias("m")
    )
    in_order = Window.orderBy("at", "time", "level")
    sofar = in_order.rowsBetween(Window.unboundedPreceding, -1)
    rows = firsts.select("level", "m.*")
    # the slide of the first arrival; its rows may be of several levels, the first in order counts
    start = F.floor(F.first("clock").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) / slide).cast("bigint") + 1
    rows = rows.withColumn("before", F.greatest(F.max("level").over(sofar), start)).where(F.col("level") > F.col("before"))
    ends = F.pmod("time", slide) == 0
    sure = ~ends | (F.col("level") > F.col("before") + 1) | (F.row_number().over(in_order) == 1)
    rows = rows.withColumn("ends", ends).withColumn("run", F.sum(F.when(sure, 1).otherwise(0)).over(in_order))
    in_run = Window.partitionBy("run").orderBy("at", "time", "level")
    # one more than the level, after this row: as its kind says at the head of a run, then in turns
    turn = (F.row_number().over(in_run) - 1) % 2 == 0
    ahead = F.when(turn, F.first("ends").over(in_run)).otherwise(~F.first("ends").over(in_run))
    rows = rows.withColumn("ahead", ahead)
    held = F.coalesce(F.lag("ahead").over(in_order), F.lit(False)) & (F.col("level") == F.col("before") + 1)
    return rows.withColumn("held", held).where(~F.col("held")).select(
        F.col("at").alias(arrival), F.col("time").alias("watermark_ms"),
        ((F.floor(F.col("time") / slide).cast("bigint") + 1) * slide).alias("boundary_ms"),
    )


def with_lateness(
    df: DataFrame, window_ms: int, lateness_ms: int, watermark: Column, time_ms: str = "ts_ms"
) -> DataFrame:
    """Add window bounds (ms) and the class ``on_time``, ``late`` or ``dropped``.

    Row-local: needs no shuffle.
    """
    start = F.col(time_ms) - F.pmod(F.col(time_ms), F.lit(window_ms))
    max_ts = F.col("window_start_ms") + (window_ms - 1)
    return (
        df.withColumn("window_start_ms", start)
        .withColumn("_wm", watermark)
        .withColumn(
            "lateness",
            F.when(max_ts + lateness_ms <= F.col("_wm"), F.lit(DROPPED))
            .when(max_ts <= F.col("_wm"), F.lit(LATE))
            .otherwise(F.lit(ON_TIME)),
        )
        .drop("_wm")
    )


def pane_counts(
    classified: DataFrame, keys: Sequence[str], value: str | None = None
) -> DataFrame:
    """Rows (and total of ``value``) in the on-time and the final pane of each window.

    The final pane holds the on-time rows and the admitted late ones. Both panes
    come from one grouping.
    """
    on_time = F.col("lateness") == ON_TIME
    aggs = [F.count_if(on_time).alias("on_time_n"), F.count(F.lit(1)).alias("final_n")]
    if value is not None:
        aggs += [
            F.sum(F.when(on_time, F.col(value))).alias("on_time_total"),
            F.sum(value).alias("final_total"),
        ]
    kept = classified.where(F.col("lateness") != DROPPED)
    return kept.groupBy("window_start_ms", *keys).agg(*aggs)


def panes(counts: DataFrame) -> DataFrame:
    """One row per fired pane from :func:`pane_counts`.

    A window that saw late rows only fires no on-time pane.
    """
    names = [n for n in ("n", "total") if f"final_{n}" in counts.columns]
    rest = [c for c in counts.columns if not c.startswith((f"{ON_TIME}_", f"{FINAL}_"))]
    pane = F.array(*[
        F.struct(F.lit(p).alias("pane"), *[F.col(f"{p}_{n}").alias(n) for n in names])
        for p in (ON_TIME, FINAL)
    ])
    return counts.select(*rest, F.inline(pane)).where(F.col("n") > 0)
