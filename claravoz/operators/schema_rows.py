"""Schema records, drift and renames found in rows.

A field's type is a set of the kinds that its values have; joining two sets is the
union, so records of parts, days or loads of the same version merge in any order. Beside it
goes a theta sketch of the values: exact up to its size, it unites with others and tells
how much two fields have in common, so a field that is gone and a new one with the same
values are seen as a rename without reading old rows. A record is one row a field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of values and their bits.
KINDS = {"integer": 1, "float": 2, "boolean": 4, "string": 8, "object": 16, "array": 32}
#: Logarithm of the distinct values that a sketch holds exactly.
SKETCH_BITS = 12


def kind_bit(value: Column) -> Column:
    """Bit of the kind of a variant; null is of no kind."""
    kind = F.schema_of_variant(value)
    other = {"STRING": "string", "BOOLEAN": "boolean", "BIGINT": "integer"}
    found = F.when(kind.startswith("OBJECT"), KINDS["object"]).when(kind.startswith("ARRAY"), KINDS["array"]).when(kind == "VOID", 0)
    for name, to in other.items():
        found = found.when(kind == name, KINDS[to])
    return found.otherwise(F.when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), KINDS["float"]).otherwise(KINDS["string"]))


def type_of(kinds: Column) -> Column:
    """Name of a set of kinds: the kind, float for whole and broken numbers, null for none, else mixed."""
    named = F.when(kinds == 0, "null").when(kinds == (KINDS["integer"] | KINDS["float"]), "float")
    for name, bit in KINDS.items():
        named = named.when(kinds == bit, name)
    return named.otherwise("mixed")


def field_values(df: DataFrame, version: str, document: str | None = None) -> DataFrame:
    """(version, field, value): the fields of each row, of a JSON column or of all other columns.

    Text that is no JSON object has no fields. A null document or version is left out.
    """
    whole = F.to_json(F.struct(*(f"`{c}`" for c in df.columns if c != version)), {"ignoreNullFields": "false"})
    fields = F.from_json(F.col(document) if document else whole, "map<string,variant>")
    return df.where(F.col(version).isNotNull()).select(F.col(version).cast("string").alias("version"), F.explode(fields).alias("field", "value"))


def field_record(df: DataFrame, version: str, document: str | None = None, bits: int = SKETCH_BITS) -> DataFrame:
    """(version, field, kinds, rows, nulls, sketch) of every field of every version.

    One scan; rows combine to a row a field before they are shuffled.
    """
    values = field_values(df, version, document).select("version", "field", F.coalesce(kind_bit(F.col("value")), F.lit(0)).alias("_kind"),
                                                        F.col("value").cast("string").alias("_text"))
    return values.groupBy("version", "field").agg(
        F.bit_or("_kind").alias("kinds"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_kind") == 0).alias("nulls"),
        F.theta_sketch_agg("_text", bits).alias("sketch"))


def merged_records(records: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """Records of parts of the same versions as one each."""
    return records.groupBy("version", "field").agg(
        F.bit_or("kinds").alias("kinds"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.theta_union_agg("sketch", bits).alias("sketch"))


def described(records: DataFrame) -> DataFrame:
    """(version, field, type, rows, nulls, distinct) of records; distinct is exact up to the sketch's size."""
    return records.select("version", "field", type_of(F.col("kinds")).alias("type"), "rows", "nulls",
                          F.theta_sketch_estimate("sketch").alias("distinct"))


def string_fields(records: DataFrame) -> DataFrame:
    """(version, field) of the fields that hold text only."""
    return records.where(type_of(F.col("kinds")) == "string").select("version", "field")


def with_previous_version(records: DataFrame) -> DataFrame:
    """(version, previous) for each version but the first, in order of their names; a row a version."""
    return records.select("version").distinct().withColumn(
        "previous", F.lag("version").over(Window.partitionBy(F.lit(0)).orderBy("version"))).where("previous IS NOT NULL")


def version_drift(records: DataFrame, overlap: float = 0.5, least_values: int = 3) -> DataFrame:
    """(version, previous, change, field, new_field, type_before, type_now, overlap) for each two versions in a row.

    Changes are added, removed, retyped and renamed. A removed and an added field of the
    same type are a rename if each is the other's best match and the share of the smaller
    one's values that both have is ``overlap`` or more; fields of fewer than ``least_values``
    values agree by chance and are not matched. Ties go to the first name.
    """
    pairs = with_previous_version(records)
    typed = records.withColumn("type", type_of(F.col("kinds")))
    now = pairs.join(typed, "version").select("version", "previous", "field", F.col("type").alias("type_now"), F.col("sketch").alias("_now"))
    then = pairs.join(typed.withColumnRenamed("version", "previous"), "previous").select(
        "version", "previous", "field", F.col("type").alias("type_before"), F.col("sketch").alias("_then"))
    both = now.join(then, ["version", "previous", "field"], "full_outer")
    gone, new = both.where("type_now IS NULL"), both.where("type_before IS NULL")
    matched = gone.select("version", "field", F.col("type_before").alias("type"), "_then").join(
        new.select("version", F.col("field").alias("new_field"), F.col("type_now").alias("type"), "_now"), ["version", "type"])
    size = F.least(F.theta_sketch_estimate("_then"), F.theta_sketch_estimate("_now"))
    shared = matched.where(size >= least_values).select(
        "version", "field", "new_field", (F.theta_sketch_estimate(F.theta_intersection("_then", "_now")) / size).alias("overlap")).where(F.col("overlap") >= overlap)
    best = lambda key: F.row_number().over(Window.partitionBy("version", key).orderBy(F.desc("overlap"), "field", "new_field"))
    renamed = shared.withColumns({"_a": best("field"), "_b": best("new_field")}).where("_a = 1 AND _b = 1").drop("_a", "_b")
    change = F.when(F.col("type_before").isNull(), "added").when(F.col("type_now").isNull(), "removed").when(
        F.col("type_now") != F.col("type_before"), "retyped")
    changes = both.withColumn("change", change).where("change IS NOT NULL").drop("_now", "_then")
    old = changes.where("change != 'added'").join(renamed, ["version", "field"], "left")
    taken = renamed.select("version", F.col("new_field").alias("field"))
    added = changes.where("change = 'added'").join(taken, ["version", "field"], "left_anti")
    types = new.select("version", F.col("field").alias("new_field"), F.col("type_now").alias("_type"))
    old = old.join(types, ["version", "new_field"], "left").withColumns({
        "change": F.when(F.col("new_field").isNotNull(), "renamed").otherwise(F.col("change")), "type_now": F.coalesce("type_now", "_type")})
    columns = ["version", "previous", "change", "field", "new_field", "type_before", "type_now", "overlap"]
    return old.select(*columns).unionByName(added.select(*columns[:4], F.lit(None).cast("string").alias("new_field"), "type_before", "type_now",
                                                         F.lit(None).cast("double").alias("overlap")))
