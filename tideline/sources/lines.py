"""Text-line feeds: readers and line parsers.

Every parser takes any DataFrame with a ``value STRING`` column, batch or
streaming, so a file, socket or message-queue source plugs in unchanged. Extra
columns (an arrival id, say) are carried along. By default a malformed line
fails the job; ``permissive=True`` drops malformed lines instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import text as txt

# The fields of a position report line, in line order.
VEHICLE_FIELDS = ["type", "time", "car_id", "speed", "xway", "lane", "dir", "seg", "pos"]
POSITION_REPORT = 0
SEGMENTS_PER_XWAY = 100

# Payload widths of the text, stock and vehicle records.
TEXT_PADDING = 3500
STOCK_PADDING = 1664
VEHICLE_PADDING = 2048


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of the text files under ``path``."""
    return spark.read.text(path)


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Streaming form of :func:`read_lines`."""
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def _parsed(
    lines: DataFrame, fields: dict[str, tuple[Column, str]], shape_ok: Column, permissive: bool,
    separator: str = " ",
) -> DataFrame:
    rest = [c for c in lines.columns if c != "value"]
    lines = lines.withColumn("_el", F.split("value", separator))
    if not permissive:
        checked = lines.where(
            F.when(shape_ok, F.lit(True)).otherwise(
                F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))).cast("boolean")
            )
        )
        return checked.select(*rest, *[c.cast(t).alias(n) for n, (c, t) in fields.items()])
    tried = lines.where(shape_ok).select(
        *rest, *[c.try_cast(t).alias(n) for n, (c, t) in fields.items()]
    )
    return tried.dropna(subset=list(fields))


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_millis("ts"))


def stock_prices(lines: DataFrame, permissive: bool = False) -> DataFrame:
    """``symbol price ts`` lines, blank separated, ``ts`` in milliseconds."""
    el = F.col("_el")
    fields = {
        "symbol": (F.get(el, F.lit(0)), "string"),
        "price": (F.get(el, F.lit(1)), "double"),
        "ts": (F.get(el, F.lit(2)), "bigint"),
    }
    return _stamped(_parsed(lines, fields, F.size(el) >= 3, permissive))


def tweets(lines: DataFrame, permissive: bool = False) -> DataFrame:
    """Lines of free text whose last word is ``ts`` in milliseconds.

    The text keeps the blank in front of the time.
    """
    ts = F.substring_index("value", " ", -1)
    text = F.substring(F.col("value"), F.lit(1), F.length("value") - F.length(ts))
    fields = {"text": (text, "string"), "ts": (ts, "bigint")}
    return _stamped(_parsed(lines, fields, F.lit(True), permissive))


def triples(lines: DataFrame, permissive: bool = False) -> DataFrame:
    """``text value seq`` lines of exactly three words."""
    el = F.col("_el")
    fields = {
        "text": (F.get(el, F.lit(0)), "string"),
        "number": (F.get(el, F.lit(1)), "int"),
        "seq": (F.get(el, F.lit(2)), "bigint"),
    }
    return _parsed(lines, fields, F.size(el) == 3, permissive).withColumnRenamed("number", "value")


def texts(lines: DataFrame, padding: int = 0) -> DataFrame:
    """Non-empty lines as ``(text, value = 1)``, padded where asked."""
    text = txt.padded("value", padding) if padding else F.col("value")
    rest = [c for c in lines.columns if c != "value"]
    return lines.where(F.length("value") > 0).select(
        *rest, text.alias("text"), F.lit(1).alias("value")
    )


def with_arrival_time(feed: DataFrame) -> DataFrame:
    """Stamp rows with the time they are processed, for processing-time windows."""
    return feed.withColumn("arrival_time", F.current_timestamp())


def with_segment(reports: DataFrame, max_segment: int = SEGMENTS_PER_XWAY) -> DataFrame:
    """Add the segment number counted over all expressways."""
    return reports.withColumn("abs_seg", F.col("xway") * max_segment + F.col("seg"))


def with_location(reports: DataFrame) -> DataFrame:
    """Add the ``(abs_seg, lane, pos)`` struct a stopped vehicle is matched on."""
    return reports.withColumn("location", F.struct("abs_seg", "lane", "pos"))


def vehicle_reports(lines: DataFrame, permissive: bool = False) -> DataFrame:
    """Position reports from comma separated vehicle lines.

    Lines of other record types are left out before any field is cast. ``time``
    is in milliseconds.
    """
    el = F.col("_el")
    types = {"time": "bigint"}
    fields = {
        name: (F.get(el, F.lit(i)), types.get(name, "int"))
        for i, name in enumerate(VEHICLE_FIELDS)
        if name != "type"
    }
    of_type = lines.where(F.substring_index("value", ",", 1) == F.lit(str(POSITION_REPORT)))
    reports = _parsed(of_type, fields, F.size(el) >= len(VEHICLE_FIELDS), permissive, ",")
    return with_segment(reports).withColumn("event_time", F.timestamp_millis("time"))


def fan_out(reports: DataFrame, factor: int, key: str = "car_id", time: Column | None = None) -> DataFrame:
    """Replicate each report for the keys 1..factor, optionally with a new time."""
    out = reports.withColumn(key, F.explode(F.sequence(F.lit(1), F.lit(factor))))
    return out if time is None else out.withColumn("time", time)


def with_payload(df: DataFrame, size: int) -> DataFrame:
    """Add a filler column of ``size`` characters."""
    return df.withColumn("payload", F.repeat(F.lit("X"), F.lit(size)))


def symbol_mentions(feed: DataFrame, text: str = "text") -> DataFrame:
    """One row per word of the text, upper-cased, as ``symbol``."""
    rest = [c for c in feed.columns if c != text]
    exploded = feed.select(*rest, F.explode(txt.words(text)).alias("word"))
    return exploded.select(*rest, F.upper("word").alias("symbol"))


def only_symbols(feed: DataFrame, symbols: DataFrame | list[str]) -> DataFrame:
    """Rows whose symbol is in a list or in the ``symbol`` column of a table."""
    if isinstance(symbols, DataFrame):
        return feed.join(symbols.select("symbol"), "symbol", "left_semi")
    return feed.where(F.col("symbol").isin(symbols))


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Bag union of feeds by column name."""
    return reduce(DataFrame.unionByName, feeds)
