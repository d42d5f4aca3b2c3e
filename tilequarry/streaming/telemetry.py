"""Telemetry lines as a stream: parsed rows, appended to files until a time limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.telemetry import parse
from ..sources.writers import telemetry_rows


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(ts_epoch, raw) of text files that appear in a folder."""
    return spark.readStream.text(folder).select(F.unix_timestamp(F.current_timestamp()).cast("double").alias("ts_epoch"), F.col("value").alias("raw"))


def log(lines: DataFrame, path: str, checkpoint: str, max_seconds: float | None = None) -> StreamingQuery:
    """Append parsed lines to CSV files; with max_seconds the query ends once that time is over, after its last batch."""
    rows = telemetry_rows(parse(lines))
    query = rows.writeStream.format("csv").option("header", True).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
    if max_seconds is not None and not query.awaitTermination(max_seconds):
        query.processAllAvailable()
        query.stop()
    return query
