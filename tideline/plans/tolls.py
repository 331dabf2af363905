"""Road tolls: segment speed, stopped vehicles, accidents and tolls per window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.windows import tumbling, window_bounds
from tideline.operators.windowed import first_row, last_row, mean_and_count

# Fixed values of the toll formula.
STOPPED_REPORTS = 4
ACCIDENT_VEHICLES = 2
FREE_FLOW_SPEED = 40
FREE_VEHICLES = 50

LOCATION = ["abs_seg", "lane", "pos"]


def segment_speed(reports: DataFrame, window: str) -> DataFrame:
    """Integer mean speed and number of reports per segment and window."""
    return mean_and_count(reports, window, ["abs_seg"], "speed", "avg_speed")


def stopped_vehicles(reports: DataFrame, window: str, keep: str = "first") -> DataFrame:
    """Vehicles with four or more reports at one location in a window.

    Speed and direction are those of the first (or last) report.
    """
    pick = {"first": first_row, "last": last_row}[keep]
    grouped = pick(
        reports, window, ["car_id", *LOCATION], ["speed", "dir"], "arrival",
        F.count(F.lit(1)).alias("n"),
    )
    return grouped.where(F.col("n") >= STOPPED_REPORTS)


def _stopped_places(reports: DataFrame, window: str) -> DataFrame:
    per_car = reports.groupBy(tumbling(window).alias("window"), "car_id", *LOCATION).agg(
        F.count(F.lit(1)).alias("n")
    ).where(F.col("n") >= STOPPED_REPORTS)
    per_place = per_car.groupBy("window", *LOCATION).agg(F.count(F.lit(1)).alias("vehicles"))
    return per_place.where(F.col("vehicles") >= ACCIDENT_VEHICLES)


def accidents(reports: DataFrame, window: str) -> DataFrame:
    """Locations where two or more vehicles stopped in a window."""
    return window_bounds(_stopped_places(reports, window))


def toll(avg_speed: Column, n: Column, accident: Column) -> Column:
    """Toll of a segment: free after an accident, in free flow or when few drive."""
    free = accident | (avg_speed > FREE_FLOW_SPEED) | (n <= FREE_VEHICLES)
    return F.when(free, F.lit(0.0)).otherwise(2 * F.pow(n - FREE_VEHICLES, F.lit(2.0)))


def tolls(reports: DataFrame, window: str) -> DataFrame:
    """Toll per segment and window.

    One scan rolled up three times: reports per (car, location), then per
    location with its number of stopped vehicles, then per segment. The segment
    statistic and the accidents come out of the same rows, so nothing is joined.
    The same plan runs on a stream with a watermark, in append mode.
    """
    per_car = reports.groupBy(tumbling(window).alias("window"), "car_id", *LOCATION).agg(
        F.sum("speed").alias("speed"), F.count(F.lit(1)).alias("n")
    )
    per_place = per_car.groupBy("window", *LOCATION).agg(
        F.sum("speed").alias("speed"),
        F.sum("n").alias("n"),
        F.count_if(F.col("n") >= STOPPED_REPORTS).alias("stopped"),
    )
    per_segment = per_place.groupBy("window", "abs_seg").agg(
        F.sum("speed").alias("speed"),
        F.sum("n").alias("n"),
        F.max(F.col("stopped") >= ACCIDENT_VEHICLES).alias("accident"),
    )
    return window_bounds(per_segment).select(
        "window_start", "window_end", "abs_seg",
        toll(F.expr("speed div n"), F.col("n"), F.col("accident")).alias("toll"),
    )


def tolls_from_parts(speed: DataFrame, accident: DataFrame) -> DataFrame:
    """Toll per segment and window from a segment statistic and accident rows.

    For statistics and accidents that were computed (or stored) separately. The
    two sides are put together by a tagged union and one grouping. A segment
    that only had an accident gets a toll of zero.
    """
    key = ["window_start", "window_end", "abs_seg"]
    tagged = speed.select(*key, "avg_speed", "n", F.lit(False).alias("accident")).unionByName(
        accident.select(*key, F.lit(True).alias("accident")), allowMissingColumns=True
    )
    merged = tagged.groupBy(*key).agg(
        F.max("avg_speed").alias("avg_speed"), F.max("n").alias("n"),
        F.max("accident").alias("accident"),
    )
    return merged.select(
        *key, toll(F.col("avg_speed"), F.col("n"), F.col("accident")).alias("toll")
    )
