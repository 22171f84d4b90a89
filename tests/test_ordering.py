import random

import pytest
from pyspark.sql import functions as F

from claravoz.operators import ordering
from claravoz.sources import records


@pytest.mark.parametrize("range_rows", [10, 250, 10 ** 6])
def test_numbers_are_those_of_a_sort(spark, range_rows):
    rnd = random.Random(range_rows)
    rows = [(rnd.choice([None, "a", "é", "z", ""]), i if rnd.random() < 0.9 else None, f"p{i}") for i in range(3000)]
    rows += [("hot", i, "x" * 50) for i in rnd.sample(range(100_000), 2000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "a string, b long, payload string").repartition(5, "payload")
    found = ordering.number_all(df.select("a", "b", "payload"), ["a", "b", "payload"], range_rows=range_rows).collect()
    order = lambda r: tuple((x is not None, x.encode() if isinstance(x, str) else x or 0) for x in r[:3])
    assert [tuple(r[:3]) for r in sorted(found, key=lambda r: r["record_index"])] == sorted(rows, key=order)
    assert sorted(r["record_index"] for r in found) == list(range(5000))


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "k int")
    assert ordering.number_all(none, ["k"]).count() == 0
    assert [r["record_index"] for r in ordering.number_all(spark.range(1), ["id"]).collect()] == [0]


def test_ranges_are_about_equal_and_nothing_is_checkpointed(spark):
    df = spark.range(40_000).select((F.col("id") * 7919 % 40_009).alias("k"))
    bounds = ordering.range_bounds(df, ["k"], 16, 40_000)
    sizes = [r["n"] for r in df.join(bounds).groupBy(ordering.bound_of(F.struct("k"), F.col("_bounds"), 16).alias("b")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 40_000 / 16
    plan = ordering.number_all(df, ["k"])._jdf.queryExecution().toString()
    assert "ExternalRDD" not in plan and "ReliableCheckpoint" not in plan


def test_each_range_is_a_task_and_wide_rows_make_more_ranges(spark):
    df = spark.range(40_000).select((F.col("id") * 7919 % 40_009).alias("k"))
    for options in ({"range_rows": 2_500}, {"row_bytes": 4_000, "range_bytes": 10_000_000}):
        placed = ordering.number_all(df, ["k"], **options).groupBy(F.spark_partition_id()).count().collect()
        assert len(placed) == 16 and max(r["count"] for r in placed) < 2 * 2_500
    rows = spark.createDataFrame([(1, "é", None), (2, None, b"abcd")], "n long, t string, b binary")
    assert records.row_bytes(rows) == 3 and records.row_bytes(rows.select("n")) == records.row_bytes(rows.limit(0)) == 0
