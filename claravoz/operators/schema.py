"""Schema records, drift, type detection and the casts they lead to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claravoz.functions import dates, text
from claravoz.operators import quality
from claravoz.operators.ordering import with_previous

# Share of non-null values that must read as a type.
DETECTION_SHARE = 0.8


def string_columns(df: DataFrame) -> list[str]:
    """Names of the string columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def schema_record(df: DataFrame, source: str, version: str | None = None) -> DataFrame:
    """One row: version, source, field names, types and count, time."""
    stamp = F.lit(version) if version else dates.version_stamp()
    return df.sparkSession.range(1).select(
        stamp.alias("version"), F.lit(source).alias("source_path"),
        F.array(*(F.lit(f.name) for f in df.schema.fields)).alias("fields"),
        F.array(*(F.lit(f.dataType.simpleString()) for f in df.schema.fields)).alias("types"),
        F.lit(len(df.columns)).alias("field_count"), F.current_timestamp().alias("extracted_at"),
    )


def field_table(df: DataFrame) -> DataFrame:
    """One row per field: (field, type)."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "field string, type string")


def schema_drift(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Fields (field, type) that were added, removed, or changed their type."""
    now = current.select("field", F.col("type").alias("type_now"))
    then = previous.select("field", F.col("type").alias("type_before"))
    both = now.join(then, "field", "full_outer")
    change = (
        F.when(F.col("type_before").isNull(), "added").when(F.col("type_now").isNull(), "removed")
        .when(F.col("type_now") != F.col("type_before"), "retyped")
    )
    return both.withColumn("change", change).where(F.col("change").isNotNull())


def _fixed_type(data_type: T.DataType) -> str | None:
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, T.FractionalType) and not isinstance(data_type, T.DecimalType):
        return "float"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, T.TimestampType | T.TimestampNTZType):
        return "datetime"
    if isinstance(data_type, T.StringType):
        return None
    return data_type.simpleString()


def detected_types(found: quality.Profile, schema: T.StructType, phase: str = "before",
                   share: float = DETECTION_SHARE) -> DataFrame:
    """Types (column, type) from a profile that includes the detection flags."""
    booleans, days = found.flags(phase, "boolean_like"), found.flags(phase, "date_like")
    nulls = found.flags(phase, "null_count")
    entries = []
    for f in schema.fields:
        fixed = _fixed_type(f.dataType)
        if fixed is None:
            filled = found.rows(phase) - nulls[f.name]
            kind = (
                F.when((filled > 0) & (booleans[f.name] > share * filled), "boolean")
                .when((filled > 0) & (days[f.name] > share * filled), "date").otherwise("string")
            )
        else:
            kind = F.lit(fixed)
        entries.append(F.struct(F.lit(f.name).alias("column"), kind.alias("type")))
    return found.row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def detect_schema(df: DataFrame, sample_rows: int | None = None,
                  share: float = DETECTION_SHARE) -> DataFrame:
    """Type of every column; strings that mostly read as booleans or dates are named so.

    All rows are looked at, in one scan, unless ``sample_rows`` is given.
    """
    if sample_rows is not None:
        df = df.limit(sample_rows)
    found = quality.profile(df, {"before": quality.cells_of(df)}, quality.DETECTION_FLAGS, duplicates=False)
    return detected_types(found, df.schema, "before", share)


def cleaning_columns(df: DataFrame, types: Mapping[str, str], sanitize: bool = True,
                     excel_safe: bool = True, mode: str = "strict") -> dict[str, tuple[Column, T.DataType]]:
    """Cleaned string columns given detected types: new expression and type per name.

    Boolean-like columns become booleans and date-like ones ISO text; the
    others are stripped and, when asked, sanitised, which strips as well. Other types
    stay. Each column is cleaned by itself, so the stage's method stays small.
    """
    cleaned: dict[str, tuple[Column, T.DataType]] = {}
    for name in string_columns(df):
        value = F.col(f"`{name}`")
        kind = types.get(name, "string")
        if kind == "boolean":
            cleaned[name] = (text.once(text.script_strip(value), lambda x: text.normalize_boolean(x, stripped=True)),
                             T.BooleanType())
        elif kind == "date":
            cleaned[name] = (text.once(text.script_strip(value), lambda x: dates.iso_date(x, stripped=True)), T.StringType())
        elif sanitize:
            cleaned[name] = (text.once(value, lambda x: text.sanitize_text(x, excel_safe, mode)), T.StringType())
        else:
            cleaned[name] = (text.strip(value), T.StringType())
    return cleaned


def clean(df: DataFrame, types: Mapping[str, str], sanitize: bool = True,
          excel_safe: bool = True, mode: str = "strict") -> DataFrame:
    """All cleaning steps as one projection."""
    columns = cleaning_columns(df, types, sanitize, excel_safe, mode)
    return df.withColumns({name: value for name, (value, _) in columns.items()})


def clean_survey(df: DataFrame, sanitize: bool = True, excel_safe: bool = True) -> DataFrame:
    """Fixed-schema cleaning: plan, comentario, outage_flag, fecha; one projection."""
    types = {f.name: f.dataType for f in df.schema.fields}
    comment, day = F.col("comentario"), F.col("fecha")
    return df.withColumns({
        "plan": text.strip(F.col("plan")),
        "comentario": text.once(comment, lambda x: text.sanitize_text(x, excel_safe)) if sanitize else text.strip(comment),
        "outage_flag": text.normalize_boolean(F.col("outage_flag"), types["outage_flag"]),
        "fecha": text.once(text.script_strip(day), lambda x: dates.iso_date(x, stripped=True))
        if isinstance(types["fecha"], T.StringType) else dates.iso_date(day, data_type=types["fecha"]),
    })


def blocked_attacks(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column, rows of sanitised text that still show traces of an attack."""
    names = list(columns or string_columns(df))
    counts = df.agg(*(
        F.count_if(text.still_suspicious(F.col(f"`{c}`"))).alias(f"b{i}") for i, c in enumerate(names)
    ))
    entries = F.explode(F.array(*(
        F.struct(F.lit(c).alias("column"), F.col(f"b{i}").alias("blocked"))
        for i, c in enumerate(names)
    )))
    return counts.select(entries.alias("e")).select("e.*")


def curate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cast nps and timestamp of a mapped table; split rows that break a constraint.

    Constraints: ``user_id`` not empty, ``timestamp`` readable, ``nps`` between
    0 and 10 where given. Returns (accepted, rejected with the reasons).
    """
    casted = df.withColumns({
        "_nps": F.expr("try_cast(nps AS INT)"),
        "_timestamp": F.try_to_timestamp(F.col("timestamp")),
    })
    reasons = F.array_compact(F.array(
        F.when(F.coalesce(text.strip(F.col("user_id")), F.lit("")) == "", F.lit("user_id empty")),
        F.when(F.col("_timestamp").isNull(), F.lit("timestamp unreadable")),
        F.when(F.col("nps").isNotNull() & (F.col("_nps").isNull() | ~F.col("_nps").between(0, 10)),
               F.lit("nps out of range")),
    ))
    judged = casted.withColumn("violations", reasons)
    accepted = judged.where(F.size("violations") == 0).withColumns(
        {"nps": F.col("_nps"), "timestamp": F.col("_timestamp")}
    ).drop("_nps", "_timestamp", "violations")
    rejected = judged.where(F.size("violations") > 0).drop("_nps", "_timestamp")
    return accepted, rejected


def history_guardrails(history: DataFrame) -> DataFrame:
    """Alerts over an audit history (source, version, content_hash, fields array<struct<field,type>>).

    A content hash that repeats within a source, and per pair of consecutive
    versions the fields that disappeared or changed type, with how often that
    happened to the field before and including that version.
    """
    repeated = (
        history.groupBy("source", "content_hash")
        .agg(F.count(F.lit(1)).alias("times"), F.max("version").alias("version"))
        .where("times > 1")
        .select("source", "version", F.lit("repeated_content").alias("alert"),
                F.col("content_hash").alias("subject"), "times")
    )
    steps = with_previous(
        history.select("source", "version", "fields"), ["source"], ["version"], {"before": "fields"}
    ).where(F.col("before").isNotNull())
    names = F.transform("fields", lambda f: f["field"])
    gone = F.filter("before", lambda f: ~F.array_contains(names, f["field"]))
    retyped = F.filter("before", lambda old: F.exists(
        "fields", lambda new: (new["field"] == old["field"]) & (new["type"] != old["type"])))
    changes = steps.select("source", "version", F.explode(F.concat(
        F.transform(gone, lambda f: F.struct(F.lit("field_removed").alias("alert"), f["field"].alias("subject"))),
        F.transform(retyped, lambda f: F.struct(F.lit("type_drift").alias("alert"), f["field"].alias("subject"))),
    )).alias("c")).select("source", "version", "c.*")
    seen = changes.groupBy("source", "alert", "subject").agg(
        F.count(F.lit(1)).alias("times"), F.max("version").alias("version")
    ).select("source", "version", "alert", "subject", "times")
    return repeated.unionByName(seen)


def infer_schema_json(spark: SparkSession, path: str, fmt: str = "csv",
                      options: Mapping[str, str] | None = None) -> str:
    """JSON of the schema Spark infers from the data, for later casts."""
    from claravoz.sources.readers import CSV_OPTIONS

    chosen = {**CSV_OPTIONS, "inferSchema": "true", **(options or {})}
    return spark.read.format(fmt).options(**chosen).load(path).schema.json()
