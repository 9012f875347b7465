"""Sequences as a stream: stateless features, and token counts by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import kmers


def read_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def feature_stream(stream: DataFrame, keep: list[str], seq: str = "seq") -> DataFrame:
    """The batch operator on a stream; it keeps no state."""
    return kmers.feature_table(stream, keep, seq)


def events_by_window(stream: DataFrame, ts: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by key and event-time window; state older than the watermark is dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("n"))
