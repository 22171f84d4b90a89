"""End-to-end jobs: ingest, convert, enrich, export, rank, search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claravoz.operators import feedback, headers, quality, schema
from claravoz.operators.embedding import hashed_vectors
from claravoz.operators.neighbors import semantic_search
from claravoz.operators.sentiment import score_with_model
from claravoz.sources import csv_ranges, inventory, readers, records, sinks
from claravoz.streaming.files import STATUS, with_status

#: Size of the sketches in audits: 2^12 values of a column are held exactly, 32 KB at most.
SKETCH_BITS = 12


@dataclass(frozen=True)
class IngestResult:
    """Where an ingest left its tables, and what it found."""

    version: str
    output: str
    rows: int
    malformed: int
    report: headers.MappingReport
    audit: DataFrame
    drift: DataFrame | None

    def good(self, spark: SparkSession) -> DataFrame:
        """The accepted rows."""
        return _status(spark, self.output, "good")

    def quarantined(self, spark: SparkSession) -> DataFrame:
        """The malformed rows."""
        return _status(spark, self.output, "malformed")


def _status(spark: SparkSession, path: str, status: str) -> DataFrame:
    rows = spark.read.parquet(path).where(F.col(STATUS) == status).drop(STATUS)
    return rows.drop(readers.CORRUPT) if status == "good" else rows


def ingest(spark: SparkSession, source: str, output: str, history: str, fmt: str = "csv",
           canonical: Mapping[str, Sequence[str]] = headers.CANONICAL, match: str = "tokens",
           options: Mapping[str, str] | None = None, profile: bool = True,
           table_format: str = "parquet", profile_bytes: int | None = None,
           partition_by: Sequence[str] = ()) -> IngestResult:
    """Profile, read as strings, map headers, write, audit.

    Files are read in ranges of bytes by as many tasks as they need, multi-line files and JSON
    documents included; Spark parses their records. Files with the same header and
    delimiter are one scan; headers are mapped scan by scan and the rows united by name,
    so neither another order of columns nor another separator puts a value under a
    wrong name. No file name reaches the driver, only layouts. Encodings are UTF-8,
    UTF-16 by its mark, Windows-1252 and Latin-1. Good and malformed rows go to two
    partitions of the same write, and the audit reads the columnar result. With parser
    options other than a separator, other formats, or without ``profile``, ``source`` is
    one scan of Spark's own reader, whose files share one layout. ``profile_bytes`` is
    accepted for older callers; a profile has no size limit. ``partition_by`` names further
    partition columns, as mapped. Schema, drift, audit and description are appended below
    ``history``.
    """
    options = dict(options or {})
    found, separator = None, options.get("sep") or options.get("delimiter")
    if profile:
        found = inventory.profile(spark, source, delimiter=separator if separator in csv_ranges.DELIMITERS else None)
        bad = found.files.where(~F.col("passed") & ~_only_uneven()).select("path", "errors")
        shown = bad.limit(20).collect()
        if shown:
            names = "; ".join(f"{r['path']}: {', '.join(r['errors'])}" for r in shown)
            more = bad.count() - len(shown)
            raise ValueError(names + (f"; and {more} more, see inventory.profile_files" if more else ""))
    version = spark.range(1).select(schema.dates.version_stamp()).first()[0]
    if found and fmt == "csv" and set(options) <= {"sep", "delimiter"} and separator in (None, *csv_ranges.DELIMITERS):
        scans = readers.csv_scans(found)
    elif found and fmt == "json" and not options:
        scans = [readers.json_scan(found)]
    else:
        scans = [readers.read_raw(spark, source, fmt, options, corrupt=True)]
    parts, originals, reports = [], [], []
    for raw in scans:
        data = raw.drop(readers.CORRUPT)
        named, one = headers.map_columns(data, canonical, match=match)
        parts.append(raw.select(*(
            F.col(f"`{old}`").alias(new) for old, new in zip(data.columns, named.columns)), readers.CORRUPT))
        originals.append(data)
        reports.append(one)
    renamed, data, report = readers.united(parts), readers.united(originals), headers.merged(reports)
    renamed = renamed.select(*(f"`{c}`" for c in renamed.columns if c != readers.CORRUPT), readers.CORRUPT)
    mapped = renamed.drop(readers.CORRUPT)

    previous = _latest_fields(spark, f"{history}/fields")
    fields = schema.field_table(mapped)
    drift = schema.schema_drift(fields, previous) if previous is not None else None
    sinks.append_history(schema.schema_record(data, source, version), f"{history}/schemas")

    # two values, so every task writes at most two files and no shuffle is needed
    sinks.write_table(with_status(renamed), output, [STATUS, *partition_by], table_format, balance=False)
    counts = {r[STATUS]: r["count"] for r in spark.read.parquet(output).groupBy(STATUS).count().collect()}
    good = _status(spark, output, "good")
    audit = quality.validate_audit(quality.audit_record(
        good, version, source, output, report.unmapped_count, report.mapped_count, sketch_bits=SKETCH_BITS))
    sinks.append_history(audit, f"{history}/audits")
    sinks.append_history(quality.describe(good).withColumn("version", F.lit(version)),
                         f"{history}/descriptions")
    sinks.append_history(fields.withColumn("version", F.lit(version)), f"{history}/fields")
    if report.unmapped_columns:
        unmapped = spark.createDataFrame([(h,) for h in report.unmapped_columns], "header string")
        headers.log_new_headers(unmapped, f"{history}/new_headers")
    audits = spark.read.schema(audit.schema).json(f"{history}/audits").where(F.col("schema_version") == version)
    return IngestResult(version, output, counts.get("good", 0), counts.get("malformed", 0),
                        report, audits, drift)


def _only_uneven():
    """Uneven rows are quarantined by the scan, so they do not stop an ingest."""
    return (F.size("errors") == 1) & F.get("errors", F.lit(0)).rlike("differ from the header")


def _latest_fields(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        known = spark.read.schema("field string, type string, version string").json(path)
    except Exception as error:  # first ingest: no history yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    latest = known.agg(F.max("version").alias("version"))
    return known.join(F.broadcast(latest), "version", "left_semi").select("field", "type")


@dataclass(frozen=True)
class ConvertResult:
    """Outcome of a conversion: detected types, quality before and after, attacks left."""

    output: str
    types: dict[str, str]
    quality: DataFrame
    blocked: DataFrame


def convert(spark: SparkSession, source: DataFrame, output: str, sanitize: bool = True,
            excel_safe: bool = True, mode: str = "strict") -> ConvertResult:
    """Detect types, clean, write zstd Parquet, compare quality before and after.

    One scan of the source gives the report before and the types, a second
    one writes; the report after reads the written table.
    """
    before = quality.profile(
        source, {"before": quality.cells_of(source)}, quality.DETECTION_FLAGS).local()
    # one row per column
    types = {r["column"]: r["type"] for r in schema.detected_types(before, source.schema).collect()}
    sinks.write_parquet(schema.clean(source, types, sanitize, excel_safe, mode), output, "zstd", balance=False)
    written = spark.read.parquet(output)
    after = quality.profile(written, {"after": quality.cells_of(written)}).local()
    report = quality.report(quality.combined(before, after), improvements=True)
    return ConvertResult(output, types, report, schema.blocked_attacks(written))


def enrich(df: DataFrame, model, output: str, key: str = "record_id", text_col: str = "text") -> DataFrame:
    """Score and embed texts, store the results by record, return the sentiment distribution."""
    scored = hashed_vectors(score_with_model(df.select(key, text_col), model), text_col)
    sinks.write_parquet(scored, output, balance=False)
    return feedback.sentiment_distribution(df.sparkSession.read.parquet(output))


def results(spark: SparkSession, store: str, task_id: str, sentiments: DataFrame | None = None,
            limit: int = records.PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """A page of a task's records, with sentiment when given (keyed by record_index)."""
    found = records.read_records(spark, store, task_id, limit=None)
    wanted = records.page(found, limit, offset)
    if sentiments is None:
        return wanted
    return records.with_sentiment(wanted, sentiments, "record_index")


def product_ranking(survey: DataFrame, keywords: Mapping[str, str] | None = None) -> DataFrame:
    """Clean the survey table and rank its products."""
    return feedback.rank_products(feedback.preprocess_survey(survey, keywords))


__all__ = [
    "ConvertResult", "IngestResult", "convert", "enrich", "ingest", "product_ranking", "results",
    "semantic_search",
]
