"""Windowed metrics that are written early, corrected by late data, and closed by event time.

Every batch that touches a window writes its metrics as far as they are known, with a
``revision`` that counts up; when the watermark passes the window's end, a timer writes it
for good (``final``) and drops its state. So the newest revision of each window is at all
times what a batch job over the same rows gives, the windows still open included.

Tasks add their rows up before the shuffle, as an aggregation does, so one label set with
most of the events sends a few rows a task to the task that keeps its window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from claravoz.operators.telemetry import PROCESSING_BUCKETS

#: The state store that keeps states with timers; ``spark.sql.streaming.stateStore.providerClass``.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def partial_sums(rows: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums by ``keys`` within each Arrow batch of a task: fewer rows, same sums, nothing kept."""
    columns = [*keys, *sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                added = pa.Table.from_batches([batch]).group_by(list(keys)).aggregate([(s, "sum") for s in sums])
                yield from added.select([*keys, *(f"{s}_sum" for s in sums)]).rename_columns(columns).cast(batch.schema).to_batches()

    rows = rows.select(*columns)
    return rows.mapInArrow(run, rows.schema)


class _Windows(StatefulProcessor):
    """Adds partial sums to a window's totals; a timer closes it."""

    def __init__(self, sums: Sequence[str], output: Sequence[str]):
        self.sums, self.output = list(sums), list(output)

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = ", ".join(f"{s} {'double' if s == 'seconds' else 'long'}" for s in self.sums)
        self.handle, self.state = handle, handle.getValueState("totals", f"{kinds}, revision int")

    def written(self, key, totals: tuple, final: bool) -> Row:
        return Row(**dict(zip(self.output, (*key, *totals, final))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.state.exists():
            totals = list(self.state.get())
        else:
            totals = [None] * len(self.sums) + [0]
            self.handle.registerTimer(key[0] + 1)  # rows of this window are late from then on
        for row in rows:
            for i, name in enumerate(self.sums):
                if row[name] is not None:
                    totals[i] = row[name] + (totals[i] or 0)
        totals[-1] += 1
        self.state.update(tuple(totals))
        yield self.written(key, tuple(totals), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        totals = list(self.state.get())
        totals[-1] += 1
        self.state.clear()
        yield self.written(key, tuple(totals), True)

    def close(self) -> None:
        pass


def early_windows(log: DataFrame, ts: str, labels: Sequence[str], duration: str, records: str | None = None,
                  width: str = "1 hour", lateness: str = "10 minutes", buckets: Sequence[float] = PROCESSING_BUCKETS) -> DataFrame:
    """A stream of (window_start, labels, operations, records, seconds, le_*, le_inf, revision, final).

    A window closes once the newest window begins ``lateness`` after its end; rows that come
    later are dropped, rows before that correct it. Rows without a time belong to no
    window; null labels are a label of their own, null durations count as operations only. The session must keep
    state in ``STATE_STORE``.
    """
    spark = log.sparkSession
    if spark.conf.get(_PROVIDER) != STATE_STORE:
        raise ValueError(f"set {_PROVIDER} to {STATE_STORE} for windows with timers")
    within = {f"le_{i}": (F.col(duration) <= bound) for i, bound in enumerate(buckets)}

    def flag(c: Column) -> Column:
        return F.when(c, 1).otherwise(0).cast("long")

    sums = ["operations", "records", "seconds", *within, "le_inf"]
    start = F.window(F.col(ts).cast("timestamp"), width)["start"]
    rows = log.where(F.col(ts).isNotNull()).select(
        start.alias("window_start"), F.unix_millis(start).alias("window_ms"), *labels, F.lit(1).cast("long").alias("operations"),
        (F.col(records) if records else F.lit(1)).cast("long").alias("records"), F.col(duration).cast("double").alias("seconds"),
        *(flag(c).alias(n) for n, c in within.items()), flag(F.col(duration).isNotNull()).alias("le_inf"))
    keys = ["window_ms", *labels]
    added = partial_sums(rows, ["window_start", *keys], sums).withWatermark("window_start", f"{width} {lateness}")
    schema = T.StructType([*added.select(*keys, *sums).schema.fields, T.StructField("revision", T.IntegerType()), T.StructField("final", T.BooleanType())])
    written = added.groupBy(*keys).transformWithState(_Windows(sums, schema.names), schema, "append", "eventTime")
    return written.select(F.timestamp_millis("window_ms").alias("window_start"), *schema.names[1:])


def latest(written: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The newest revision of every window in what ``early_windows`` has written."""
    keys = ["window_start", *labels]
    rest = [c for c in written.columns if c not in keys]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "revision").alias("_w"))
    return newest.select(*keys, "_w.*")


def with_state_store(spark: SparkSession, run):
    """``run()`` while the session keeps state in ``STATE_STORE``; the setting is put back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, STATE_STORE)
    try:
        return run()
    finally:
        spark.conf.set(_PROVIDER, before)
