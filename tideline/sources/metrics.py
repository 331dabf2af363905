"""Counters and totals of a run, taken while its rows pass by.

``observe`` merges them from the tasks that succeeded, as accumulators of the run; no
second pass over the rows is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQuery


def watched(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` and the metrics (aggregates, by name) of the first run of it.

    ``Observation.get`` waits until the rows were written or collected.
    """
    seen = Observation()
    return df.observe(seen, *[m.alias(name) for name, m in metrics.items()]), seen


def watched_stream(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """A stream whose triggers each report ``metrics`` under ``name``."""
    return df.observe(name, *[m.alias(k) for k, m in metrics.items()])


def stream_totals(query: StreamingQuery, name: str) -> dict[str, float]:
    """Sums of the reported metrics over the triggers that the query remembers.

    Spark keeps as many as ``spark.sql.streaming.numRecentProgressUpdates`` says (100).
    """
    totals: dict[str, float] = {}
    for progress in query.recentProgress:
        row = progress.observedMetrics.get(name)
        for k, v in (row.asDict() if row else {}).items():
            totals[k] = totals.get(k, 0) + (v or 0)
    return totals
