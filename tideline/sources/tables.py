"""The benchmark tables as record feeds.

Batch feeds keep ``event_time`` as a zone-less timestamp, as the tables have it.
Arrival columns are BIGINT so that "first row" aggregates stay fixed-width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.windows import epoch_ms
from tideline.sources.lines import with_segment

HOUR_MS = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Event times are cut into windows in UTC.
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of the files it consists of."""
    schema = table(spark, sf_dir, name).schema
    # As a glob the name may be a folder of files or a single file.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


def zoned(df: DataFrame) -> DataFrame:
    """Event time with a zone, which is what watermarks ask for."""
    return df.withColumn("event_time", F.col("event_time").cast("timestamp"))


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vehicles_of(table(spark, sf_dir, "lineitem"))


def vehicles_of(lineitem: DataFrame) -> DataFrame:
    """Position reports from ``lineitem``.

    (order, line) is not unique, so the arrival number also holds the speed and
    the day; rows with the same number then agree in all report fields that are
    not fixed by car and location. It fits 63 bits up to order key 2^42.
    """
    days = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("bigint")
    speed = F.col("l_quantity").cast("int")
    arrival = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 64 + speed) * 4096 + days
    seg = F.col("l_suppkey") % 25
    reports = lineitem.select(
        F.col("l_shipdate").alias("event_time"),
        F.col("l_suppkey").cast("int").alias("car_id"),
        speed.alias("speed"),
        F.lit(0).alias("xway"),
        (F.col("l_linenumber") % 2).alias("lane"),
        F.lit(0).alias("dir"),
        seg.cast("int").alias("seg"),
        (seg * 5280 + F.col("l_partkey") % 4).cast("int").alias("pos"),
        arrival.alias("arrival"),
    )
    return with_segment(reports)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices_of(table(spark, sf_dir, "events"))


def prices_of(events: DataFrame) -> DataFrame:
    """Price ticks from ``events``."""
    return events.select(
        F.col("user_id").alias("symbol"),
        F.col("value").alias("price"),
        F.col("ts").alias("event_time"),
        F.col("event_id").alias("arrival"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions_of(table(spark, sf_dir, "events"))


def mentions_of(events: DataFrame) -> DataFrame:
    """Symbol mentions: the ``view`` rows of ``events``."""
    return events.where(F.col("event_type") == "view").select(
        F.col("user_id").alias("symbol"), F.col("ts").alias("event_time")
    )


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text records from ``conversations``; ten conversations share a bucket."""
    return table(spark, sf_dir, "conversations").select(
        F.expr("conv_id div 10").alias("bucket"),
        "text",
        F.length("text").alias("value"),
        (F.col("conv_id") * 4096 + F.col("turn")).alias("arrival"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal samples per event type and day from ``events``."""
    return table(spark, sf_dir, "events").select(
        "event_type",
        F.to_date("ts").alias("day"),
        "value",
        F.col("event_id").alias("arrival"),
    )


def late_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with event times set back by 0 to 36 hours behind arrival."""
    back = (F.col("event_id") % 4) * 12 * HOUR_MS
    ms = epoch_ms("ts")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("key"),
        "value",
        (ms - back).alias("ts_ms"),
        ms.alias("arrival_ms"),
        F.col("event_id").alias("arrival"),
    )
