"""Metrics from an event log: counters, duration histograms, throughput."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Upper bounds of the duration buckets, in seconds.
PROCESSING_BUCKETS = (0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 120.0)
HTTP_BUCKETS = (0.01, 0.05, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0)
INFERENCE_BUCKETS = (0.01, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0)


def processing_rollup(log: DataFrame, labels: Sequence[str], duration: str, records: str | None = None,
                      buckets: Sequence[float] = PROCESSING_BUCKETS) -> DataFrame:
    """Per label set: operations, records, total seconds, cumulative buckets, records per second.

    Bucket columns ``le_<n>`` count durations up to the n-th bound; the last,
    ``le_inf``, counts all.
    """
    n = F.col(records) if records else F.lit(1)
    within = [
        F.count_if(F.col(duration) <= bound).alias(f"le_{i}") for i, bound in enumerate(buckets)
    ]
    rolled = log.groupBy(*labels).agg(
        F.count(F.lit(1)).alias("operations"),
        F.sum(n).cast("long").alias("records"),
        F.sum(duration).alias("seconds"),
        *within,
        F.count(duration).alias("le_inf"),
    )
    rate = F.when(F.col("seconds") > 0, F.col("records") / F.col("seconds"))
    return rolled.withColumn("records_per_second", rate)


def event_counts(log: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Counter: events per label set."""
    return log.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))
