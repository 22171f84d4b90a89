"""Token-bucket limiter over an event log.

A bucket is sequential per key, and one key may own a third of the log, so
keys are not gathered into tasks. Events are range-partitioned in (key, time)
order and handled in two passes over the same checkpointed partitions:

1. every partition reports how it maps the tokens a key arrives with to the
   tokens it leaves with. That matters only for a key that spans partitions;
   a key that starts inside the partition starts with a full bucket.
2. with the arriving tokens known, every partition decides its own events.

Amounts are exact integers: time in microseconds, tokens in units small
enough that the refill per microsecond is whole. So the result does not
depend on where the partitions are cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claravoz.operators.ordering import ordered_partitions

_DECISION = "allowed boolean, retry_after double, tokens_left double"


@dataclass(frozen=True)
class BucketRule:
    """Burst size, refill in tokens per second, and idle seconds that drop a bucket."""

    max_tokens: int = 100
    refill_rate: float = 10.0
    cleanup_interval: float | None = None

    @property
    def _rate(self) -> Fraction:
        return Fraction(self.refill_rate).limit_denominator(1_000_000)

    @property
    def refill(self) -> int:
        """Units added per microsecond."""
        return self._rate.numerator

    @property
    def token(self) -> int:
        """Units in one token."""
        return 1_000_000 * self._rate.denominator

    @property
    def full(self) -> int:
        """Units in a full bucket."""
        return self.max_tokens * self.token

    @property
    def idle(self) -> int | None:
        """Idle microseconds after which the bucket is dropped."""
        return None if self.cleanup_interval is None else int(self.cleanup_interval * 1_000_000)

    def refilled(self, units: int, elapsed: int) -> int:
        """Tokens after ``elapsed`` microseconds."""
        if self.idle is not None and elapsed > self.idle:
            return self.full
        return min(self.full, units + elapsed * self.refill)


class Transfer:
    """Tokens after some events as a function of the tokens before the first.

    Kept as pieces (from, value, slope): for arrivals from ``from`` up to the
    next piece, the result is ``value + slope * (arrival - from)``, slope 0 or 1.
    Neighbouring pieces that continue each other are merged; what is left
    grows with the tokens a bucket holds, not with the number of events.
    """

    def __init__(self, rule: BucketRule) -> None:
        self.rule = rule
        self.pieces: list[tuple[int, int, int]] = [(0, 0, 1)]

    def _spans(self) -> Iterator[tuple[int, int, int, int]]:
        ends = [p[0] for p in self.pieces[1:]] + [self.rule.full + 1]
        for (start, value, slope), end in zip(self.pieces, ends):
            yield start, end, value, slope

    def _merge(self, pieces: list[tuple[int, int, int]]) -> None:
        merged: list[tuple[int, int, int]] = []
        for start, value, slope in pieces:
            if merged:
                s0, v0, k0 = merged[-1]
                if k0 == slope and v0 + k0 * (start - s0) == value:
                    continue
            merged.append((start, value, slope))
        self.pieces = merged

    def wait(self, elapsed: int) -> None:
        """Refill between two events."""
        full = self.rule.full
        if self.rule.refilled(0, elapsed) == full:
            self.pieces = [(0, full, 0)]
            return
        gain = elapsed * self.rule.refill
        out = []
        for start, end, value, slope in self._spans():
            value += gain
            if value >= full:
                out.append((start, full, 0))
            elif slope and value + (end - 1 - start) > full:
                out += [(start, value, 1), (start + full - value, full, 0)]
            else:
                out.append((start, value, slope))
        self._merge(out)

    def take(self, need: int) -> None:
        """One request: consume when there is enough, else leave unchanged."""
        out = []
        for start, end, value, slope in self._spans():
            if value >= need:
                out.append((start, value - need, slope))
            elif slope and value + (end - 1 - start) >= need:
                out += [(start, value, 1), (start + need - value, 0, 1)]
            else:
                out.append((start, value, slope))
        self._merge(out)

    def __call__(self, units: int) -> int:
        return _apply(self.pieces, units)


def _apply(pieces: Iterable[tuple[int, int, int]], units: int) -> int:
    result = 0
    for start, value, slope in pieces:
        if start > units:
            break
        result = value + slope * (units - start)
    return result


def micros(ts: Column) -> Column:
    """Microseconds since 1970; times without zone are read in the session's."""
    return F.unix_micros(ts.cast("timestamp"))


def token_bucket(df: DataFrame, key: str, ts: str, tie: str, rule: BucketRule,
                 tokens_required: Column | int = 1) -> DataFrame:
    """Decide every event: adds allowed, retry_after (seconds, 0 if allowed) and tokens_left.

    ``tie`` orders events of a key with equal times and must be unique. A key
    starts with a full bucket; a denied event consumes nothing.
    """
    need = tokens_required if isinstance(tokens_required, Column) else F.lit(tokens_required)
    slim = df.select(
        key, tie, micros(F.col(ts)).alias("_us"), need.cast("long").alias("_need")
    )
    rows = ordered_partitions(slim, [key], ["_us", tie])

    summaries = (
        rows.select("_pid", F.col(key).cast("string").alias("_key"), "_us", "_need")
        .mapInPandas(_summarise(rule), _SUMMARY)
        # one row per partition
        .orderBy("_pid").collect()
    )
    arriving = _arrivals(rule, summaries)
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(key, "_us", tie).schema.fields
    )
    decided = rows.withColumn("_key", F.col(key).cast("string")).mapInPandas(
        _decide(rule, arriving, [key, "_us", tie]), f"{schema}, {_DECISION}"
    ).select(key, F.timestamp_micros("_us").cast(df.schema[ts].dataType).alias(ts), tie, "allowed", "retry_after", "tokens_left")
    rest = [c for c in df.columns if c not in (key, ts, tie)]
    if not rest:
        return decided
    return df.select(tie, *rest).join(decided, tie)


_SUMMARY = (
    "_pid int, first_key string, first_us long, last_key string, last_us long, one_key boolean,"
    " starts array<long>, gains array<long>, slopes array<int>"
)


def _summarise(rule: BucketRule):
    """Per partition: its ends, and the transfer of its last key."""
    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = first_key = key = None
        first_us = last_us = 0
        one_key, seen = True, False
        transfer, units = Transfer(rule), None
        for pdf in batches:
            if pdf.empty:
                continue
            pid = int(pdf["_pid"].iloc[0])
            for k, us, need in zip(pdf["_key"].tolist(), pdf["_us"].tolist(), pdf["_need"].tolist()):
                if not seen:
                    seen, first_key, first_us, key = True, k, us, k
                elif k != key:
                    # a new key begins here with a full bucket
                    key, one_key, units = k, False, rule.full
                elif units is not None:
                    units = rule.refilled(units, us - last_us)
                else:
                    transfer.wait(us - last_us)
                last_us, need = us, need * rule.token
                if units is None:
                    transfer.take(need)
                    if len(transfer.pieces) == 1 and transfer.pieces[0][2] == 0:
                        # the same for every arrival from here on
                        units = transfer.pieces[0][1]
                elif units >= need:
                    units -= need
        if seen:
            starts, values, slopes = zip(*(transfer.pieces if units is None else [(0, units, 0)]))
            yield pd.DataFrame({
                "_pid": [pid], "first_key": [first_key], "first_us": [first_us],
                "last_key": [key], "last_us": [last_us], "one_key": [one_key],
                "starts": [list(starts)], "gains": [list(values)], "slopes": [list(slopes)],
            })

    return summarise


def _arrivals(rule: BucketRule, summaries: list) -> dict[int, int]:
    """Tokens with which the first key of each partition arrives at its first event."""
    arriving: dict[int, int] = {}
    last = None
    for s in summaries:
        units = rule.full
        if last is not None and last[0] == s["first_key"]:
            units = rule.refilled(last[1], s["first_us"] - last[2])
        arriving[s["_pid"]] = units
        pieces = list(zip(s["starts"], s["gains"], s["slopes"]))
        last = (s["last_key"], _apply(pieces, units), s["last_us"])
    return arriving


def _decide(rule: BucketRule, arriving: dict[int, int], keep: list[str]):
    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units, key, last_us, started = 0, None, 0, False
        for pdf in batches:
            if pdf.empty:
                continue
            allowed, retry, left = [], [], []
            for k, us, need in zip(pdf["_key"].tolist(), pdf["_us"].tolist(), pdf["_need"].tolist()):
                if not started:
                    units, started = arriving[int(pdf["_pid"].iloc[0])], True
                elif k != key:
                    units = rule.full
                else:
                    units = rule.refilled(units, us - last_us)
                key, last_us = k, us
                missing = need * rule.token - units
                allowed.append(missing <= 0)
                retry.append(max(missing, 0) / (rule.refill * 1_000_000))
                if missing <= 0:
                    units = -missing
                left.append(units / rule.token)
            yield pdf[keep].assign(allowed=allowed, retry_after=retry, tokens_left=left)

    return decide


def idle_keys(df: DataFrame, key: str, ts: str, now: Column, cleanup_interval: float) -> DataFrame:
    """Keys whose last event is older than the interval, with that event's time."""
    last = df.groupBy(key).agg(F.max(ts).alias("last_seen"))
    idle = micros(now) - micros(F.col("last_seen"))
    return last.where(idle > int(cleanup_interval * 1_000_000))
