"""The record store: rows of a task as JSON payloads, with paging and enrichment joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claravoz.operators.ordering import number_all

# Default and largest page.
PAGE_DEFAULT = 100
PAGE_MAX = 10_000


def row_bytes(df: DataFrame) -> float:
    """Bytes of a row's texts and binaries on average; 0 without such columns."""
    wide = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType | T.BinaryType)]
    return (df.agg(F.avg(sum(wide[1:], wide[0]).cast("long"))).first()[0] or 0.0) if wide else 0.0


def to_records(df: DataFrame, task_id: str, order: Sequence[str], first: int = 0) -> DataFrame:
    """Rows as (task_id, record_index, data): payloads numbered from ``first`` in ``order``."""
    packed = df.select(*order, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("data"))
    numbered = number_all(packed, order, row_bytes=row_bytes(df))
    return numbered.select(F.lit(task_id).alias("task_id"), (F.col("record_index") + first).alias("record_index"), "data")


def next_index(spark: SparkSession, path: str, task_id: str) -> int:
    """Index that the next record of a task gets; 0 for a store or task that is not there yet."""
    try:
        known = spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return 0
    return known.where(F.col("task_id") == task_id).agg(F.coalesce(F.max("record_index") + 1, F.lit(0))).first()[0]


def write_records(records: DataFrame, path: str) -> str:
    """Append to the store, one partition per task."""
    records.withColumn("created_at", F.current_timestamp()).write.mode("append") \
        .partitionBy("task_id").parquet(path)
    return path


def load_parquet(spark: SparkSession, source: str, task_id: str, order: Sequence[str], path: str) -> int:
    """Load a Parquet table into the store; returns how many records the task has then.

    A task that is loaded again goes on where it ended, so its indexes stay dense.
    One load of a task at a time.
    """
    first = next_index(spark, path, task_id)
    write_records(to_records(spark.read.parquet(source), task_id, order, first), path)
    return spark.read.parquet(path).where(F.col("task_id") == task_id).count()


def read_records(spark: SparkSession, path: str, task_id: str, limit: int | None = None) -> DataFrame:
    """Records of a task (partition pruned); the first ``limit`` by index if given."""
    found = spark.read.parquet(path).where(F.col("task_id") == task_id)
    if limit is not None:
        # indexes are dense, so the limit is a pushed-down filter, not a sort
        found = found.where(F.col("record_index") < limit)
    return found.select("task_id", "record_index", "data")


def parse_payload(records: DataFrame, schema: T.StructType | str, data: str = "data") -> DataFrame:
    """Payload fields as columns."""
    return records.withColumn("_d", F.from_json(data, schema)).select(
        *(c for c in records.columns if c != data), "_d.*"
    )


def page(records: DataFrame, limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """One page of a task's records, with the total number of its records.

    Record indexes are dense, so a page is a range filter on them.
    """
    if not 0 <= limit <= PAGE_MAX or offset < 0:
        raise ValueError(f"limit must be 0..{PAGE_MAX} and offset not negative")
    total = records.agg(F.count(F.lit(1)).alias("total_records"), F.lit(1).alias("_one"))
    wanted = records.where(
        (F.col("record_index") >= offset) & (F.col("record_index") < offset + limit)
    )
    # a page is at most PAGE_MAX rows and the total is one row
    return wanted.withColumn("_one", F.lit(1)).join(total, "_one").drop("_one").orderBy("record_index")


def with_sentiment(records: DataFrame, sentiments: DataFrame, key: str = "record_id") -> DataFrame:
    """Records with their sentiment columns, null where there is none."""
    return records.join(
        sentiments.select(key, "sentiment", "confidence", "positive_score", "negative_score"), key, "left"
    )


def with_text(hits: DataFrame, records: DataFrame, key: str = "record_id", text: str = "text") -> DataFrame:
    """Search hits with the text of the record."""
    return hits.join(records.select(key, text), key)
