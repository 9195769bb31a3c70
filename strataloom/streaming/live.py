"""Structured Streaming forms of the registry and of pause-separated sessions: beyond what the batch operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_stream(log: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row for each key of an append log, as a streaming aggregation (output mode complete or update)."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(key, "row.*")


def sessions(events: DataFrame, key: str, at: str, pause: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end and n of runs of events less than pause apart; events later than the watermark are left out."""
    windowed = events.withWatermark(at, late).groupBy(key, F.session_window(at, pause).alias("w"))
    return windowed.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes all that is there, then stops: a stream run as a batch job."""
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
