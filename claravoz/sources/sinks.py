"""Writing tables and exports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claravoz.functions import text
from claravoz.operators.schema import string_columns
from claravoz.sources.readers import CORRUPT, split_malformed

TARGET_MB = 128


@contextmanager
def _file_size(spark: SparkSession, target_mb: int) -> Iterator[None]:
    """Partition size adaptive execution aims at during one write."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{target_mb}m")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "overwrite",
                  target_mb: int = TARGET_MB, balance: bool = True) -> str:
    """Parquet files of about ``target_mb`` each.

    Balancing sizes partitions at run time, splitting large and merging small
    ones; it costs a shuffle, so leave it out when the input is split evenly.
    """
    with _file_size(df.sparkSession, target_mb):
        out = df.hint("rebalance") if balance else df
        out.write.mode(mode).option("compression", compression).parquet(path)
    return path


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
                mode: str = "overwrite", target_mb: int = TARGET_MB, balance: bool = True) -> str:
    """Files of any installed format (``delta`` needs its jar), partitioned by columns.

    Rebalancing on the partition columns gathers each value into few files
    and still splits a value that holds a large part of the table. Without it
    every task writes its own file per value, which is fine for few values.
    """
    with _file_size(df.sparkSession, target_mb):
        out = df.hint("rebalance", *partition_by) if balance else df
        out.write.format(fmt).mode(mode).partitionBy(*partition_by).save(path)
    return path


def quarantine(df: DataFrame, path: str) -> DataFrame:
    """Write malformed rows to ``path``; returns the good ones.

    ``df`` is a scan made with ``corrupt=True``.
    """
    good, bad = split_malformed(df)
    if CORRUPT in df.columns:
        bad.write.mode("overwrite").parquet(path)
    return good


def formula_safe(df: DataFrame) -> DataFrame:
    """Every string column escaped for spreadsheets."""
    names = string_columns(df)
    return df.withColumns({c: text.escape_formula(F.col(f"`{c}`")) for c in names}) if names else df


def export_csv(df: DataFrame, path: str, excel_safe: bool = True) -> str:
    """CSV with header, formulas escaped."""
    out = formula_safe(df) if excel_safe else df
    out.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)
    return path


def export_json(df: DataFrame, path: str) -> str:
    """JSON lines; null fields are written and non-ASCII text is kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def export(df: DataFrame, path: str, fmt: str, excel_safe: bool = True,
           sentiments: DataFrame | None = None, key: str = "record_id") -> str:
    """Export in a format by name, with sentiment columns when these are given.

    Nothing to export raises LookupError; unknown formats raise ValueError.
    """
    from claravoz.sources.records import with_sentiment

    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported format: {fmt}; use csv, json or parquet")
    if df.isEmpty():
        raise LookupError("no results to export")
    if sentiments is not None:
        df = with_sentiment(df, sentiments, key)
    if fmt == "csv":
        return export_csv(df, path, excel_safe)
    if fmt == "json":
        return export_json(df, path)
    return write_parquet(df, path)


def append_history(df: DataFrame, path: str) -> str:
    """Append rows (schema, audit, anomaly) to a JSON history on any Hadoop path."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)
    return path


def write_enrichment(df: DataFrame, path: str, key: str = "record_id") -> str:
    """Store sentiment or embedding columns keyed by record."""
    if key not in df.columns:
        raise ValueError(f"{key} is missing")
    return write_parquet(df, path, mode="append")
