"""Sinks: console, memory, window logs, firing logs and text dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def bounded_run(writer: DataStreamWriter) -> StreamingQuery:
    """Process everything that is there now, then stop."""
    return writer.trigger(availableNow=True).start()


def periodic_run(writer: DataStreamWriter, interval: str) -> StreamingQuery:
    """Run on, one trigger (and one step of the watermark) per interval."""
    return writer.trigger(processingTime=interval).start()


def console(df: DataFrame, mode: str = "append") -> DataStreamWriter:
    return df.writeStream.format("console").outputMode(mode)


def memory(df: DataFrame, name: str, mode: str = "append") -> DataStreamWriter:
    return df.writeStream.format("memory").queryName(name).outputMode(mode)


def dump_text(df: DataFrame, path: str, checkpoint: str | None = None, column: str = "value"):
    """Write one column as text files; a stream gives a writer still to be started."""
    lines = df.select(F.col(column).cast("string").alias("value"))
    if df.isStreaming:
        return (
            lines.writeStream.format("text")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
        )
    lines.write.mode("append").text(path)
    return None


def append_csv(df: DataFrame, path: str, checkpoint: str | None = None):
    """Append rows as CSV files; a stream gives a writer still to be started."""
    if df.isStreaming:
        return (
            df.writeStream.format("csv")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
        )
    df.write.mode("append").csv(path)
    return None


def window_log(counts: DataFrame) -> DataFrame:
    """Rows ``(max_ts, n)`` of a per-window count, for :func:`append_csv`."""
    max_ts = F.unix_millis(F.col("window_end").cast("timestamp")) - 1
    return counts.select(max_ts.alias("max_ts"), "n")


def firing_log(panes: DataFrame, window_ms: int | None = None) -> DataFrame:
    """Rows ``(pane, window_end)``, one per fired pane, for :func:`append_csv`.

    Panes that carry ``window_start_ms`` only need the window's length.
    """
    if "window_end" in panes.columns:
        return panes.select("pane", "window_end")
    end = F.timestamp_millis(F.col("window_start_ms") + window_ms)
    return panes.select("pane", end.alias("window_end"))
