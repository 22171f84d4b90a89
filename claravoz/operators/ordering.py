"""Order-dependent work without one task per group.

A window ordered within a group pulls the whole group into one task, which
does not work when one group holds a large part of the table. Here rows are
range-partitioned on the group *and* the order columns, so Spark's sampled
bounds cut a large group into as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claravoz.scratch import reliable_checkpoint

_POSITION_BITS = 33
# Run starts (a few numbers per row) are broadcast up to this many.
BROADCAST_ROWS = 200_000


def ordered_partitions(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Checkpointed rows in global (keys, order) order with ``_pid`` and ``_pos``.

    ``_pid`` numbers the partitions in that order and ``_pos`` the rows inside
    one. Both are stored by the checkpoint: range bounds come from a sample,
    so a second evaluation of the plan could cut the rows elsewhere.
    """
    by = [*keys, *order]
    # a given number keeps adaptive execution from merging small ranges again
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    row = F.monotonically_increasing_id()
    placed = placed.withColumns({
        "_pid": F.shiftright(row, _POSITION_BITS).cast("int"),
        "_pos": row.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)),
    })
    return reliable_checkpoint(placed)


def number_rows(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (),
                name: str = "record_index") -> DataFrame:
    """Number the rows of each group from 0 in ``order``, which should be unique.

    One row per (group, partition) carries the counts; there are at most
    groups + partitions of them, and only these meet in a window.
    """
    keys = list(keys)
    rows = ordered_partitions(df, keys, order)
    runs = rows.groupBy("_pid", *keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")
    )
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        F.col("_pid").alias("_run_pid"),
        *(F.col(k).alias(f"_run_{k}") for k in keys),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    starts = reliable_checkpoint(starts)
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    same = F.col("_pid") == F.col("_run_pid")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_run_{k}"))
    return rows.join(starts, same).select(
        *df.columns, (F.col("_pos") + F.col("_shift")).alias(name)
    )


#: Rows of a range when rows are numbered by fixed bounds, their bytes where the size of rows
#: is given, and order keys sampled for each bound.
RANGE_ROWS = 250_000
RANGE_BYTES = 64 * 1024 * 1024
SAMPLED = 50


def range_bounds(df: DataFrame, order: Sequence[str], ranges: int, rows: int) -> DataFrame:
    """One row with ``_bounds``: ascending order keys that cut ``df`` into about equal ranges.

    ``SAMPLED`` keys a range are sorted, as for any range partitioning of Spark's; the bounds
    that come back are fixed, so every scan cuts the rows at the same places.
    """
    spark, keys = df.sparkSession, df.select(F.struct(*order).alias("_key"))
    kind = keys.schema["_key"].dataType.simpleString()
    wanted = ranges * SAMPLED
    sample = keys if rows <= wanted else keys.sample(min(1.0, 1.2 * wanted / rows), seed=11)
    chosen = []
    if ranges > 1:  # the sample is as small as a driver's, so one task may sort it
        picked = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda k: F.get("_keys", (F.size("_keys") * k / ranges).cast("int")))
        found = sample.agg(F.array_sort(F.collect_list("_key")).alias("_keys")).where("size(_keys) > 0").select(picked.alias("_picked")).first()
        chosen = found["_picked"] if found else []
    return spark.createDataFrame([(chosen,)], f"_bounds array<{kind}>")


def bound_of(key: Column, bounds: Column, ranges: int) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``, by halving steps."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(ranges - 1, 1).bit_length()))))
    fits = lambda at, step: (at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) <= key)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))


def number_all(df: DataFrame, order: Sequence[str], name: str = "record_index", range_rows: int = RANGE_ROWS,
               row_bytes: float = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Number all rows from 0 in ``order``, which should be unique; rows move once.

    Fixed bounds cut the rows into ranges of about ``range_rows``, or fewer if rows of
    ``row_bytes`` on average would be more than ``range_bytes``; each range is a task of its
    own. One scan of the order columns counts them, and the running sum of the counts is where each range begins. The
    cut does not depend on the evaluation, so nothing is checkpointed. ``df`` must give the
    same rows each time, as a table does.
    """
    spark = df.sparkSession
    rows = df.count()
    range_rows = max(1, min(range_rows, int(range_bytes / max(row_bytes, 1e-9))))
    ranges = max(1, min(-(-rows // 1_000), max(spark.sparkContext.defaultParallelism, -(-rows // range_rows))))
    bounds = range_bounds(df, order, ranges, rows)
    key = F.struct(*order)

    def placed(part: DataFrame) -> DataFrame:
        return part.join(F.broadcast(bounds)).withColumn("_range", bound_of(key, F.col("_bounds"), ranges)).drop("_bounds")

    counts = placed(df.select(*order)).groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).collect()  # a row a range
    starts, total = [], 0
    for r in sorted(counts, key=lambda r: r["_range"]):
        starts.append((r["_range"], total))
        total += r["_n"]
    offsets = F.broadcast(spark.createDataFrame(starts, "_range int, _start long"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    # by number, not by its hash, which would put several ranges into one task
    return placed(df).repartitionById(ranges, "_range").withColumn("_at", within).join(offsets, "_range").select(
        *df.columns, (F.col("_start") + F.col("_at")).alias(name))


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  values: dict[str, str]) -> DataFrame:
    """Add, per group, values of the row before in ``order`` (null for the first).

    ``values`` maps new column names to existing ones. The lookup is an
    equi-join on (group, row number), balanced also for one very large group.
    """
    numbered = reliable_checkpoint(number_rows(df, order, keys, "_n_row"))
    previous = numbered.select(
        *(F.col(k).alias(f"_prev_{k}") for k in keys),
        (F.col("_n_row") + 1).alias("_prev_row"),
        *(F.col(old).alias(new) for new, old in values.items()),
    )
    on: Column = F.col("_n_row") == F.col("_prev_row")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_prev_{k}"))
    return numbered.join(previous, on, "left").select(*df.columns, *values)
