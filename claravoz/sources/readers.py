"""Reading raw files without trusting their types."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claravoz.sources import csv_ranges, inventory, json_ranges
from claravoz.sources.ranges import RANGE_BYTES

CORRUPT = "_corrupt_record"
# How raw CSV is read unless the caller says otherwise.
CSV_OPTIONS = {
    "header": "true",
    "inferSchema": "false",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
}


def text_schema(columns: list[str], corrupt: bool = True) -> T.StructType:
    """All columns as strings, plus the column for records that do not fit."""
    names = [*columns, CORRUPT] if corrupt else columns
    return T.StructType([T.StructField(c, T.StringType()) for c in names])


def text_ddl(columns: list[str]) -> str:
    """``text_schema`` as text."""
    return ", ".join("`" + c.replace("`", "``") + "` string" for c in [*columns, CORRUPT])


def safe_names(header: list[str]) -> list[str]:
    """Column names of a header, none empty and none twice, as Spark's reader makes them."""
    lower = [h.lower() for h in header]
    return [f"_c{i}" if not h else f"{h}{i}" if lower.count(h.lower()) > 1 else h for i, h in enumerate(header)]


def csv_header(spark: SparkSession, path: str, options: Mapping[str, str] | None = None) -> list[str]:
    """Column names of a CSV; only the first line is read."""
    chosen = {**CSV_OPTIONS, **(options or {}), "inferSchema": "false"}
    return spark.read.options(**chosen).csv(path).columns


def json_fields(spark: SparkSession, path: str, multi_line: bool = False) -> list[str]:
    """Field names of JSON records, found by Spark's own pass over the file."""
    inferred = spark.read.option("multiLine", multi_line).option("primitivesAsString", True).json(path)
    return [c for c in inferred.columns if c != CORRUPT]


def read_raw(spark: SparkSession, path: str | list[str], fmt: str = "csv", options: Mapping[str, str] | None = None,
             columns: list[str] | None = None, corrupt: bool = False,
             ignore_corrupt_files: bool = False, schema: str | None = None) -> DataFrame:
    """Raw scan: every CSV and JSON column a string.

    ``corrupt`` adds the column with the text of records that do not fit.
    ``multiLine`` files cannot be split; pass ``{"multiLine": "false"}`` for
    large files without line breaks inside quotes. An unreadable file is an error unless
    ``ignore_corrupt_files`` skips it.
    """
    reader = spark.read.option("ignoreCorruptFiles", ignore_corrupt_files)
    fmt = fmt.lower()
    if fmt == "csv":
        chosen = {**CSV_OPTIONS, **(options or {})}
        names = columns or (csv_header(spark, path, chosen) if corrupt else None)
        reader = reader.options(**chosen)
        if names:
            reader = reader.schema(text_schema(names, corrupt)).option("columnNameOfCorruptRecord", CORRUPT)
        return reader.csv(path)
    if fmt == "json":
        chosen = {"mode": "PERMISSIVE", **(options or {})}
        multi_line = chosen.get("multiLine", "false") == "true"
        names = columns or json_fields(spark, path, multi_line)
        return (
            reader.options(**chosen).schema(text_schema(names, corrupt))
            .option("columnNameOfCorruptRecord", CORRUPT).json(path)
        )
    return (reader.schema(schema) if schema else reader).format(fmt).options(**(options or {})).load(path)


def csv_scans(found: inventory.Profile, options: Mapping[str, str] | None = None) -> list[DataFrame]:
    """One scan for each header and delimiter; layouts are few, their files stay in tables.

    ``options`` are further ones of Spark's parser for a record, such as ``nullValue``.
    """
    layouts = found.files.where("format = 'csv'").groupBy("header", "delimiter").agg(F.min("path").alias("_first")).orderBy("_first").collect()
    scans = []
    for layout in layouts:
        header = F.array(*map(F.lit, layout["header"]))
        own = found.csv_ranges.where((F.col("delimiter") == layout["delimiter"]) & (F.col("header") == header))
        chosen = {**CSV_OPTIONS, **(options or {}), "sep": layout["delimiter"], "columnNameOfCorruptRecord": CORRUPT}
        row = F.from_csv("record", text_ddl(safe_names(layout["header"])), chosen)
        scans.append(csv_ranges.records(own, found.tasks, skip_header=True).select(row.alias("row")).select("row.*"))
    return scans


def json_scan(found: inventory.Profile) -> DataFrame:
    """Documents, lines and elements of lists as rows; every field a string, fields by name."""
    values = json_ranges.values(found.json_ranges, found.tasks, whole_objects=True).where("record IS NOT NULL AND trim(record) != ''").select("record")
    names = sorted(r["field"] for r in values.select(F.explode(F.json_object_keys("record")).alias("field")).distinct().collect())
    row = F.from_json("record", text_schema(names), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return values.select(row.alias("row")).select("row.*")


def united(frames: list[DataFrame]) -> DataFrame:
    """Rows of frames with different columns, by name."""
    whole = frames[0]
    for other in frames[1:]:
        whole = whole.unionByName(other, allowMissingColumns=True)
    return whole


def read_ranges(spark: SparkSession, path: str, fmt: str = "csv", range_bytes: int = RANGE_BYTES,
                options: Mapping[str, str] | None = None) -> DataFrame:
    """Raw scan of CSV or JSON files whose bytes are dealt over tasks, multi-line records and
    whole documents included; every column a string, with the column for records that do
    not fit. Header, delimiter and encoding are those that the profile finds; ``options`` are
    those of ``csv_scans``."""
    found = inventory.profile(spark, path, range_bytes=range_bytes)
    return united(csv_scans(found, options)) if fmt == "csv" else json_scan(found)


def read_typed(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan for cleaning: Parquet, or CSV with types inferred.

    With a ``schema`` CSV cells are cast one by one, so a cell that does not
    fit becomes null and the rest of its row stays.
    """
    if path.rstrip("/").lower().endswith(".parquet"):
        return spark.read.parquet(path)
    if schema is None:
        return spark.read.options(**{**CSV_OPTIONS, "inferSchema": "true"}).csv(path)
    raw = read_raw(spark, path, columns=[f.name for f in schema.fields])
    return cast_cells(raw, schema)


def cast_cells(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast string columns by name; cells that do not fit become null."""
    return df.select(*(
        F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name)
        for f in schema.fields
    ))


# Least bytes of source data a task gets when a small table is spread.
SPREAD_BYTES = 256 * 1024


def spread_small(df: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """Spread a table of few splits over the idle cores before costly expressions.

    A file with one row group is one task, however costly the cleaning of its
    rows. A table that already fills the cores with splits of full size is
    returned unchanged, so large tables are never shuffled by this, unless
    ``task_bytes`` bounds what a task may get of the table and splits are larger.
    Meant for plain scans, whose size the planner knows.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = min(cores, size // SPREAD_BYTES)
    wide = task_bytes is not None and split > task_bytes
    if wide:
        tasks = max(tasks, -(-size // task_bytes))
    if tasks < 2 or (size >= cores * split and not wide):
        return df
    return df.repartition(tasks)


def split_malformed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, malformed) rows of a scan made with ``corrupt=True``.

    Both keep the whole schema in the scan, which Spark needs to tell which
    records are malformed, so neither side is cached.
    """
    if CORRUPT not in df.columns:
        return df, df.limit(0)
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT), df.where(F.col(CORRUPT).isNotNull())
