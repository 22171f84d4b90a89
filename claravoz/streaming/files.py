"""Incremental ingest of files dropped into a folder.

A batch is its data, in a folder of its own, and a manifest: one row with the batch's
audit, counts and schema, in one file that appears by a rename after the data is
whole. What has no manifest does not exist for ``committed``, so a batch that dies
between its data and its audit shows neither, and one that is run again after its
manifest was written changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from claravoz.operators import quality
from claravoz.sources.readers import CORRUPT, CSV_OPTIONS, text_schema

STATUS = "row_status"
_MANIFEST = "batch_id long, query_id string, good long, malformed long, schema string"


def file_stream(spark: SparkSession, folder: str, columns: list[str],
                options: Mapping[str, str] | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """New CSV files of a folder as a stream of strings with the malformed-record column."""
    chosen = {**CSV_OPTIONS, **(options or {})}
    return (
        spark.readStream.schema(text_schema(columns)).options(**chosen)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("maxFilesPerTrigger", files_per_trigger).csv(folder)
    )


def with_status(df: DataFrame) -> DataFrame:
    """Add ``row_status``: good or malformed."""
    return df.withColumn(STATUS, F.when(F.col(CORRUPT).isNull(), "good").otherwise("malformed"))


def manifests(spark: SparkSession, output: str, audit_path: str | None = None) -> DataFrame:
    """(batch_id, query_id, good, malformed, schema) of every batch that is whole; a row a batch."""
    try:
        return spark.read.schema(_MANIFEST).json(audit_path or f"{output}/_manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def committed(spark: SparkSession, output: str, audit_path: str | None = None) -> DataFrame:
    """The rows of all batches that have a manifest, with ``batch_id`` and ``row_status``.

    Batch numbers, eight bytes each, become a filter on the partitions: files of other batches
    are not opened. The columns are those of the newest batch; none at all without a batch.
    """
    known = manifests(spark, output, audit_path)
    newest = known.agg(F.max_by("schema", "batch_id").alias("schema"), F.collect_list("batch_id").alias("ids")).first()
    if not newest["ids"]:
        return spark.createDataFrame([], f"batch_id long, {STATUS} string")
    schema = T.StructType.fromJson(json.loads(newest["schema"]))
    return spark.read.schema(schema).parquet(output).where(F.col("batch_id").isin(newest["ids"]))


def ingest_stream(spark: SparkSession, folder: str, columns: list[str], output: str, checkpoint: str,
                  clean: Callable[[DataFrame], DataFrame] | None = None, audit_path: str | None = None,
                  options: Mapping[str, str] | None = None, files_per_trigger: int = 1000) -> StreamingQuery:
    """Clean new files into a table and audit every batch; read it with ``committed``.

    The table is partitioned by ``batch_id`` and ``row_status``; the audits, which are the
    manifests too, go to ``audit_path`` or a hidden folder of the table. A batch touches only its own folders,
    and is written once however often it runs. Batch numbers belong to a checkpoint: a table
    that another query has written to is refused. Batch size is bounded by ``files_per_trigger``.
    """
    audits = audit_path or f"{output}/_manifest"

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        query = session.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        before = manifests(session, output, f"{audits}/batch_id={batch_id}").select("query_id").first()
        if before:
            if before["query_id"] != query:
                raise ValueError(f"batch {batch_id} of {output} was written by another query than that of {checkpoint}")
            return
        out, seen, path = with_status(clean(batch) if clean else batch), Observation(), f"{output}/batch_id={batch_id}"
        counted = out.observe(seen, F.count_if(F.col(STATUS) == "good").alias("good"), F.count_if(F.col(STATUS) != "good").alias("malformed"))
        counted.write.mode("overwrite").partitionBy(STATUS).parquet(path)
        good = session.read.schema(out.schema).parquet(path).where(F.col(STATUS) == "good").drop(STATUS, CORRUPT)
        counts = seen.get
        whole = T.StructType([*out.schema.fields, T.StructField("batch_id", T.LongType())])
        audit = quality.validate_audit(quality.audit_record(good, str(batch_id), folder, output)).withColumns({
            "query_id": F.lit(query), "good": F.lit(counts["good"]), "malformed": F.lit(counts["malformed"]), "schema": F.lit(whole.json())})
        audit.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{audits}/batch_id={batch_id}")

    stream = file_stream(spark, folder, columns, options, files_per_trigger)
    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
