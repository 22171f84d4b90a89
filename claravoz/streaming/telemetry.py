"""Windowed metrics over an event stream with late data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claravoz.operators.telemetry import PROCESSING_BUCKETS, processing_rollup


def windowed_rollup(log: DataFrame, ts: str, labels: Sequence[str], duration: str,
                    records: str | None = None, width: str = "1 hour", slide: str | None = None,
                    lateness: str = "10 minutes",
                    buckets: Sequence[float] = PROCESSING_BUCKETS) -> DataFrame:
    """Processing metrics per time window and label set.

    Works on a stream (closed windows, append mode; events later than
    ``lateness`` are dropped) and on a table alike. ``slide`` makes windows overlap.
    """
    if log.isStreaming:
        log = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    rolled = processing_rollup(log.withColumn("_w", span), ["_w", *labels], duration, records, buckets)
    return rolled.select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
        *(c for c in rolled.columns if c != "_w"),
    )
