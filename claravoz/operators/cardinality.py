"""Distinct values of columns over the versions of a table, from the sketches kept with its audits.

An audit of ``quality.audit_record(sketch_bits=...)`` holds a theta sketch of each column's
values. Sketches unite, and tell what two have in common, so how a column's values
changed from version to version, and how many it has had over all versions, needs no
old data: only a row a column and version is read. Estimates are exact up to the sketch's size
of 2^bits values, beyond it the relative error is about 1 / sqrt(2^bits).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column_history(audits: DataFrame, version: str = "schema_version") -> DataFrame:
    """(version, column, rows, nulls, sketch): a row for each column of each audit.

    Audits of the same version (parts of one load) become one. Audits without sketches and
    columns without a sketch are left out; a column of nulls has an empty sketch.
    """
    each = audits.select(F.col(version).cast("string").alias("version"), "rows", F.col("nulls").alias("_nulls"),
                         F.explode("sketches").alias("column", "sketch")).where("sketch IS NOT NULL AND version IS NOT NULL")
    return each.groupBy("version", "column").agg(
        F.sum("rows").alias("rows"), F.sum(F.try_element_at("_nulls", F.col("column"))).alias("nulls"), F.theta_union_agg("sketch").alias("sketch"))


def total_cardinality(history: DataFrame) -> DataFrame:
    """(column, versions, rows, distincts): values that a column has had in all versions together."""
    return history.groupBy("column").agg(
        F.count(F.lit(1)).alias("versions"), F.sum("rows").alias("rows"), F.theta_sketch_estimate(F.theta_union_agg("sketch")).alias("distincts"))


def cardinality_drift(history: DataFrame, limit: float = 0.5) -> DataFrame:
    """(version, previous, column, distincts, distincts_before, gained, lost, null_share, null_share_before, alerts)
    of each column and each version that has the column in a version before it, in order of version names.

    ``gained`` values are new, ``lost`` ones are gone. Alerts: ``collapsed`` if the number fell by
    more than ``limit`` of what it was, ``grown`` if it rose by more, ``replaced`` if more than ``limit`` of the
    earlier values are gone, ``null_share`` if the share of nulls moved by more than ``limit``.
    """
    order = Window.partitionBy("column").orderBy("version")  # a row a version: bounded by the history, not by the data

    def before(name: str) -> Column:
        return F.lag(name).over(order)

    share = F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).otherwise(0.0)
    pairs = history.withColumn("null_share", share).select(
        "version", before("version").alias("previous"), "column", "sketch", before("sketch").alias("_then"),
        "null_share", before("null_share").alias("null_share_before")).where("previous IS NOT NULL")
    counted = pairs.select(
        "version", "previous", "column", F.theta_sketch_estimate("sketch").alias("distincts"),
        F.theta_sketch_estimate("_then").alias("distincts_before"),
        F.theta_sketch_estimate(F.theta_difference("sketch", "_then")).alias("gained"),
        F.theta_sketch_estimate(F.theta_difference("_then", "sketch")).alias("lost"), "null_share", "null_share_before")
    was = F.col("distincts_before")
    return counted.withColumn("alerts", F.array_compact(F.array(
        F.when(was - F.col("distincts") > limit * was, F.lit("collapsed")),
        F.when((F.col("distincts") - was > limit * was), F.lit("grown")),
        F.when(F.col("lost") > limit * was, F.lit("replaced")),
        F.when(F.abs(F.col("null_share") - F.col("null_share_before")) > limit, F.lit("null_share")))))
