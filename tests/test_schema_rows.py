import json

from pyspark.sql import functions as F

from claravoz.operators import schema_rows


def rows(spark, documents):
    return spark.createDataFrame([(v, json.dumps(x) if not isinstance(x, str | None) else x) for v, x in documents], "version string, doc string")


def changes(records, **more):
    found = schema_rows.version_drift(records, **more).collect()
    return {(r["version"], r["change"], r["field"], r["new_field"]) for r in found}


def test_types_join_in_any_order(spark):
    docs = [("1", {"a": 1, "b": 1, "c": None, "d": True, "e": [1], "f": {"x": 1}, "g": 1}), ("1", {"a": 2, "b": 1.5, "d": False, "g": "1"}), ("1", "no json"),
            ("1", None), (None, {"z": 1}), ("1", "[1]")]
    want = {"a": ("integer", 2, 0, 2), "b": ("float", 2, 0, 2), "c": ("null", 1, 1, 0), "d": ("boolean", 2, 0, 2), "e": ("array", 1, 0, 1),
            "f": ("object", 1, 0, 1), "g": ("mixed", 2, 0, 1)}
    whole = schema_rows.field_record(rows(spark, docs), "version", "doc")
    parts = [schema_rows.field_record(rows(spark, docs[k:k + 1]), "version", "doc") for k in (3, 1, 0, 2)]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    for records in (whole, schema_rows.merged_records(united)):
        got = {r["field"]: (r["type"], r["rows"], r["nulls"], r["distinct"]) for r in schema_rows.described(records).collect()}
        assert got == want


def test_renames(spark):
    """A rename with new values besides, a false friend of the same name shape, small fields, two candidates."""
    colours, cities = ["red", "blue", "green", "black"], ["Rom", "Bonn", "Kiel", "Lima"]
    docs = [("2024-1", {"colour": c, "town": t, "flag": i % 2, "id": i}) for i, (c, t) in enumerate(zip(colours * 5, cities * 5))]
    docs += [("2024-2", {"color": c, "towel": t, "mark": i % 2, "id": str(i), "tint": c if i % 4 else "odd"})
             for i, (c, t) in enumerate(zip([*colours, "white"] * 4, ["a", "b", "c", "d", "e"] * 4))]
    records = schema_rows.field_record(rows(spark, docs), "version", "doc")
    assert changes(records) == {
        ("2024-2", "renamed", "colour", "color"), ("2024-2", "removed", "town", None), ("2024-2", "added", "towel", None), ("2024-2", "added", "tint", None),
        ("2024-2", "removed", "flag", None), ("2024-2", "added", "mark", None), ("2024-2", "retyped", "id", None)}
    assert ("2024-2", "renamed", "flag", "mark") in changes(records, least_values=2)


def test_columns_and_many_versions(spark):
    df = spark.range(30).select((F.col("id") % 3).alias("v"), "id", F.lit("x").alias("s"), F.lit(None).cast("string").alias("n"))
    records = schema_rows.field_record(df, "v")
    assert changes(records) == set() and records.count() == 9
    assert {r["field"] for r in schema_rows.string_fields(records).collect()} == {"s"}
    assert schema_rows.with_previous_version(records).count() == 2
    assert changes(records.limit(0)) == set()


def test_large_fields_share_values(spark):
    """Beyond the sketch's size the overlap is an estimate, near the true one."""
    old = spark.range(30_000).select(F.lit("a").alias("v"), F.to_json(F.struct(F.col("id").alias("left"))).alias("doc"))
    new = spark.range(6_000, 36_000).select(F.lit("b").alias("v"), F.to_json(F.struct(F.col("id").alias("right"))).alias("doc"))
    found = schema_rows.version_drift(schema_rows.field_record(old.unionByName(new), "v", "doc")).first()
    assert (found["change"], found["new_field"]) == ("renamed", "right") and abs(found["overlap"] - 0.8) < 0.06
