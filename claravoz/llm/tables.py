"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claravoz.scratch import scratch_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again.

    This cuts the lineage, and a lost executor loses nothing of it. Row numbers
    and partition numbers taken before the write stay as they were.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def row_id() -> Column:
    """A number that tells rows apart, also where ``doc_id`` is null or repeats."""
    return F.monotonically_increasing_id()


def join_by_run(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """``rows`` (with ``run``, the partition a row came from) joined to ``found`` on ``key``.

    The distinct keys of each run look up ``found``, then the rows look up their own
    run, so no key of a join has more rows than a run, however common a key is.
    """
    return rows.join(rows.select("run", key).distinct().join(found, key), ["run", key])


def text_key(docs: DataFrame) -> dict[str, Column]:
    """Columns that identify a row by its id and its text, none of them null."""
    text = text_of(docs)
    kind = docs.schema["doc_id"].dataType
    return {
        "_key_null": F.col("doc_id").isNull(), "_key_id": F.coalesce(F.col("doc_id"), F.lit(0).cast(kind)),
        "_key_text": F.xxhash64(text), "_key_size": F.length(text),
    }


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``text_key`` is in ``kept``, one for each key.

    One shuffle of the documents. Spark takes the first row of each key before it
    shuffles, so many repeats of one row do not meet in a task.
    """
    key = text_key(docs)
    once = Window.partitionBy(*key).orderBy("_key_size")
    keyed = docs.withColumns(key).withColumn("_key_row", F.row_number().over(once)).where("_key_row = 1")
    return keyed.join(kept.select(*key), list(key), "left_semi").select(*docs.columns)
