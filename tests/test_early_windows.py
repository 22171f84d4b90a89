"""Early, corrected and final windows of a stream equal a batch job over the same rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from claravoz.streaming import windows
from claravoz.streaming.telemetry import windowed_rollup

SCHEMA = "ts timestamp, layer string, seconds double, n int"
START = datetime.datetime(2024, 1, 1)


def test_newest_revisions_equal_batch(spark, tmp_path):
    rnd = random.Random(5)

    def row(minute):
        return (START + datetime.timedelta(minutes=minute), rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, 0.25, 2.0, 70.0]), rnd.randrange(4))

    batches = [[row(rnd.randrange(0, 100)) for _ in range(60)] + [(None, "a", 1.0, 1)],
               [row(rnd.randrange(60, 130)) for _ in range(40)] + [row(5)],  # 5: late, its window is open still
               [row(rnd.randrange(240, 300)) for _ in range(30)],
               [row(400), row(290)], [row(10)]]  # 10: its window is closed
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))

    def run():
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
            stream = windows.early_windows(spark.readStream.schema(SCHEMA).parquet(src), "ts", ["layer"], "seconds", "n")
            stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(ValueError, match="stateStore"):
        windows.early_windows(spark.readStream.schema(SCHEMA).parquet(str(tmp_path)), "ts", ["layer"], "seconds")
    windows.with_state_store(spark, run)
    written = spark.read.parquet(out)
    kept = spark.createDataFrame([r for rows in batches[:-1] for r in rows], SCHEMA)
    columns = ["window_start", "layer", "operations", "records", "seconds", *(f"le_{i}" for i in range(8)), "le_inf"]
    want = {tuple(r) for r in windowed_rollup(kept, "ts", ["layer"], "seconds", "n").select(columns).collect()}
    newest = windows.latest(written, ["layer"])
    assert {tuple(r) for r in newest.select(columns).collect()} == want
    finals = {r["window_start"].hour for r in newest.where("final").collect()}
    assert finals == {0, 1, 2, 4} - ({2} - {w[0].hour for w in want})  # the window of minute 400 is open
    assert written.groupBy("window_start", "layer", "revision").count().where("count > 1").count() == 0
    first = written.where((F.col("window_start") == START) & (F.col("layer") == "a")).orderBy("revision").collect()
    assert [r["final"] for r in first] == [False] * (len(first) - 1) + [True]


def test_partial_sums_keep_nulls(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2.0, 1), (None, None, 1), (None, None, 2)], "k string, x double, n long").coalesce(1)
    assert {tuple(r) for r in windows.partial_sums(df, ["k"], ["x", "n"]).collect()} == {("a", 2.0, 2), (None, None, 3)}
    assert windows.partial_sums(df.limit(0), ["k"], ["x", "n"]).count() == 0
