"""Distinct counts from one scan, and their sketches over versions."""

import datetime
import random
from functools import reduce

import duckdb
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claravoz.operators import cardinality, quality
from claravoz.sources import readers

SCHEMA = "i int, s string, d double, t date, a array<string>, m map<string,int>, r struct<x:int,y:int>, `a.b` string, _digits string"


def rows_of(seed, n):
    rnd = random.Random(seed)
    maybe = lambda v: None if rnd.random() < 0.2 else v
    return [(maybe(rnd.randrange(9)), maybe(rnd.choice(["", " ", "a", "b", "é"])), maybe(rnd.choice([0.0, -0.0, 1.5, float("nan")])),
             maybe(datetime.date(2020, 1, rnd.randint(1, 9))), maybe([rnd.choice(["x", None, ""])] * rnd.randint(0, 2)),
             maybe({"k": rnd.randrange(3)}), maybe((maybe(1), maybe(1))), maybe(""), maybe("z")) for _ in range(n)]


def value(v):
    if isinstance(v, float):
        return "nan" if v != v else v + 0.0
    return repr(v) if isinstance(v, list | dict | tuple) else v


def test_counts_match_brute_force(spark):
    rows = rows_of(1, 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["column"]: r for r in quality.column_stats(df).collect()}
    assert list(got) == df.columns
    for i, c in enumerate(df.columns):
        cells = [r[i] for r in rows]
        assert got[c]["nulls"] == sum(v is None for v in cells)
        assert got[c]["empty_strings"] == (sum(v == "" for v in cells) if c in ("s", "a.b", "_digits") else 0)
        assert got[c]["distincts"] == len({value(v) for v in cells if v is not None}), c
    near = {r["column"]: r for r in quality.column_stats(df, approximate=True).collect()}
    assert {c: (r["nulls"], r["empty_strings"]) for c, r in near.items()} == {c: (r["nulls"], r["empty_strings"]) for c, r in got.items()}
    assert all(abs(near[c]["distincts"] - got[c]["distincts"]) <= 1 for c in got)


def test_audit_is_one_scan_without_expand(spark, tmp_path):
    df = spark.createDataFrame(rows_of(2, 200), SCHEMA).drop("m")
    df.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    for audit in (quality.audit_record(table, "v", "in", "out", sketch_bits=12), quality.audit_record(table, "v", "in", "out", approximate=True)):
        plan = audit._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Expand" not in plan
        row = audit.first()
        assert (row["rows"], row["content_hash"]) == tuple(quality.content_hash(table).first())
        assert row["nulls"]["s"] == table.where("s IS NULL").count() and sorted(row["nulls"]) == sorted(table.columns)
    none = quality.audit_record(table.limit(0), "v", "in", "out", sketch_bits=12).first()
    assert (none["rows"], none["content_hash"]) == (0, "0") and set(none["distincts"].values()) == {0}
    assert {r["distincts"] for r in quality.column_stats(table.limit(0)).collect()} == {0}


def test_sketches_survive_the_json_history(spark, tmp_path):
    path = str(tmp_path / "audits")
    parts = [("1", ["a", "b", "c", None]), ("1", ["c", "d"]), ("2", ["c", "d", "e"]), ("3", [None, None, None])]
    for version, values in parts:
        df = spark.createDataFrame([(v,) for v in values], "s string")
        audit = quality.audit_record(df, version, "in", "out", sketch_bits=12)
        audit.write.mode("append").json(path)
    history = cardinality.column_history(spark.read.schema(audit.schema).json(path))
    assert {(r["version"], r["rows"], r["nulls"]) for r in history.collect()} == {("1", 6, 1), ("2", 3, 0), ("3", 3, 3)}
    total, = cardinality.total_cardinality(history).collect()
    assert (total["versions"], total["rows"], total["distincts"]) == (3, 12, 5)
    drift = {r["version"]: r for r in cardinality.cardinality_drift(history).collect()}
    assert set(drift) == {"2", "3"}
    two, three = drift["2"], drift["3"]
    assert (two["previous"], two["distincts"], two["distincts_before"], two["gained"], two["lost"], two["alerts"]) == ("1", 3, 4, 1, 2, [])
    assert (three["distincts"], three["lost"], three["alerts"]) == (0, 3, ["collapsed", "replaced", "null_share"])


def test_large_sketches_are_near(spark):
    halves = [spark.range(a, a + 40_000).select(F.col("id").cast("string").alias("s")) for a in (0, 20_000)]
    audits = reduce(DataFrame.unionByName, [quality.audit_record(h, str(i), "in", "out", sketch_bits=12) for i, h in enumerate(halves)])
    history = cardinality.column_history(audits)
    assert abs(cardinality.total_cardinality(history).first()["distincts"] - 60_000) < 3_600
    drift = cardinality.cardinality_drift(history).first()
    assert abs(drift["gained"] - 20_000) < 3_000 and abs(drift["lost"] - 20_000) < 3_000
    assert [r["distincts"] for r in quality.column_stats(halves[0]).collect()] == [40_000]


def test_content_hash_writes_signed_zeros_as_sql_does(spark):
    values = [0.0, -0.0, -0.0, 4516.95, None]
    table = spark.createDataFrame([(x,) for x in values], "x double")
    sql = "SELECT CAST(sum(CAST(('0x' || substr(sha256(to_json({'x': x})), 1, 15)) AS HUGEINT)) AS VARCHAR) FROM (SELECT unnest(?::DOUBLE[]) AS x)"
    want = duckdb.execute(sql, [values]).fetchone()[0]
    audit = quality.audit_record(table, "v", "s", "o").first()
    assert quality.content_hash(table).first()["content_hash"] == audit["content_hash"] == want
    assert audit["distincts"] == {"x": 2}  # equal where values are compared


def test_a_task_gets_no_more_of_a_table_than_asked_for(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(600_000).select(F.xxhash64("id").alias("k")).coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert readers.spread_small(table).rdd.getNumPartitions() == 4
    bounded = readers.spread_small(table, task_bytes=size // 10)
    rows = [r["count"] for r in bounded.groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) in (10, 11) and max(rows) < 2 * min(rows)
    assert quality.column_stats(bounded).first()["distincts"] == 600_000
