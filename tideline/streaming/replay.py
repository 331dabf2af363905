"""Replay a table as a stream in arrival order, and run a stream to a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.session import shared_dir

Job = Callable[[DataFrame], DataFrame]


def to_table(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that is there now and append the result to ``path``."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _end_mark(spark: SparkSession, schema: T.StructType, values: dict[str, object]) -> DataFrame:
    """One row of far-future time, whose own window stays open and so never comes out."""
    return spark.range(1).select(
        *[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema]
    )


def replay(
    df: DataFrame, part: Column, parts: int, job: Job, end: dict[str, object] | None = None
) -> DataFrame:
    """Feed ``df`` to ``job`` in ``parts`` steps and return all it emitted.

    ``part`` numbers the step of each row from 0. Each step is written to the
    shared folder by all tasks and is one micro-batch; the job goes on from its
    checkpoint, so a lost step is run again from there. ``end`` is a row (by column)
    of far-future time, fed last to close all windows.
    """
    spark = df.sparkSession
    base = shared_dir(spark, "replay")
    numbered = df.withColumn("_part", part)
    for step in range(parts):
        numbered.where(F.col("_part") == step).drop("_part").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{base}/in")
        to_table(spark, job(stream), f"{base}/out", f"{base}/state")
    if end:
        _end_mark(spark, df.schema, end).write.mode("append").parquet(f"{base}/in")
        to_table(spark, job(stream), f"{base}/out", f"{base}/state")
    return spark.read.schema(job(stream).schema).parquet(f"{base}/out")


def once(stream: DataFrame, job: Job, end: dict[str, object] | None = None) -> DataFrame:
    """Run ``job`` over what a streaming source holds now; returns what it emitted.

    Without ``end`` the last windows stay open. ``end`` is a row (by column) of
    far-future time; it is fed after all others and so closes them.
    """
    spark = stream.sparkSession
    base = shared_dir(spark, "once")
    if end:
        mark = _end_mark(spark, stream.schema, end)
        mark.where("false").write.parquet(f"{base}/end")
        marks = spark.readStream.schema(stream.schema).parquet(f"{base}/end")
        stream = stream.unionByName(marks)
    result = job(stream)
    to_table(spark, result, f"{base}/out", f"{base}/state")
    if end:
        mark.write.mode("append").parquet(f"{base}/end")
        to_table(spark, result, f"{base}/out", f"{base}/state")
    return spark.read.schema(result.schema).parquet(f"{base}/out")
