"""Token-bucket limiter on a stream, one bucket of state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from claravoz.operators.limits import BucketRule, micros

_STATE = "units long, last_us long"


def _decide(rule: BucketRule, key: str, tie: str):
    def decide(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        events = pd.concat(list(batches)).sort_values(["event_us", tie])
        units, last = state.get if state.exists else (rule.full, None)
        allowed, retry, left = [], [], []
        for us, need in zip(events["event_us"].tolist(), events["event_need"].tolist()):
            if last is not None:
                # an event that arrives late finds the bucket as it is
                units = rule.refilled(units, max(us - last, 0))
            last = us if last is None else max(us, last)
            missing = need * rule.token - units
            allowed.append(missing <= 0)
            retry.append(max(missing, 0) / (rule.refill * 1_000_000))
            if missing <= 0:
                units = -missing
            left.append(units / rule.token)
        state.update((units, last))
        if rule.cleanup_interval is not None:
            state.setTimeoutDuration(max(1, int(rule.cleanup_interval * 1000)))
        yield pd.DataFrame({
            key: events[key], "event_us": events["event_us"], tie: events[tie],
            "allowed": allowed, "retry_after": retry, "tokens_left": left,
        })

    return decide


def token_bucket_stream(events: DataFrame, key: str, ts: str, tie: str, rule: BucketRule,
                        tokens_required: int = 1) -> DataFrame:
    """Decide every event of a stream: (key, ts, tie, allowed, retry_after, tokens_left).

    Events of one key within a micro-batch are handled together, so bound the
    batch at the source (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``); for
    a log at rest use the batch operator, which splits large keys. State is two
    numbers per key; with a ``cleanup_interval`` keys idle that long are dropped,
    which takes a continuous trigger (with timeouts ``availableNow`` does not end).
    """
    slim = events.select(
        key, tie, micros(F.col(ts)).alias("event_us"), F.lit(tokens_required).cast("long").alias("event_need")
    )
    fields = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(key, "event_us", tie).schema.fields
    )
    timeout = GroupStateTimeout.NoTimeout if rule.cleanup_interval is None \
        else GroupStateTimeout.ProcessingTimeTimeout
    decided = slim.groupBy(key).applyInPandasWithState(
        _decide(rule, key, tie),
        f"{fields}, allowed boolean, retry_after double, tokens_left double",
        _STATE, "append", timeout,
    )
    time = F.timestamp_micros("event_us").cast(events.schema[ts].dataType).alias(ts)
    return decided.select(key, time, tie, "allowed", "retry_after", "tokens_left")
