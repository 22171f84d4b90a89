import pytest
from pyspark.sql import functions as F

from claravoz.operators import limits, quality, schema, sentiment
from claravoz.operators.sentiment import SentimentTransformer
from claravoz.plans import jobs
from claravoz.scratch import scratch_root
from claravoz.sources import inventory, readers, records, sinks
from claravoz.streaming import files as stream_files
from claravoz.streaming.limits import token_bucket_stream
from claravoz.streaming.telemetry import windowed_rollup



def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


# --- sources ----------------------------------------------------------------------------


def test_ragged_csv_is_split(spark, tmp_path):
    path = write(tmp_path / "r.csv", 'a,b\n1,2\n3,4,5\n6\n"x\n')
    raw = readers.read_raw(spark, path, options={"multiLine": "false"}, corrupt=True)
    good, bad = readers.split_malformed(raw)
    assert [tuple(r) for r in good.collect()] == [("1", "2")] and len(bad.collect()) == 3
    kept = sinks.quarantine(raw, str(tmp_path / "q"))
    assert kept.collect() == good.collect() and spark.read.parquet(str(tmp_path / "q")).count() == 3


def test_bad_json_line_is_split(spark, tmp_path):
    path = write(tmp_path / "r.json", '{"a":1}\n{bad\n{"a":2}\n')
    good, bad = readers.split_malformed(readers.read_raw(spark, path, "json", corrupt=True))
    assert sorted(r["a"] for r in good.collect()) == ["1", "2"] and len(bad.collect()) == 1
    plain = readers.read_raw(spark, write(tmp_path / "m.json", '[{"a": 1},\n {"a": 2}]'), "json", {"multiLine": "true"})
    assert sorted(r["a"] for r in plain.collect()) == ["1", "2"]


def test_typed_scan(spark, tmp_path):
    path = write(tmp_path / "t.csv", "a,b\n1,2.5\nx,3\n")
    typed = readers.read_typed(spark, path, spark.createDataFrame([], "a int, b double").schema)
    assert [tuple(r) for r in typed.collect()] == [(1, 2.5), (None, 3.0)]
    assert dict(readers.read_typed(spark, path).dtypes) == {"a": "string", "b": "double"}


def test_file_checks(spark, tmp_path):
    d = tmp_path / "in"
    write(d / "empty.csv", "")
    write(d / "one.csv", "a;b\n")
    write(d / "uneven.csv", "a,b\n1,2\n1,2,3\n4\n")
    write(d / "quoted.csv", '"a,1",b\n"x\ny",2\n')
    write(d / "latin.csv", "a,b\nse\xf1or,1\n".encode("latin-1"))
    write(d / "list.json", "[1, 2, 3]")
    write(d / "broken.json", "[1, 2")
    write(d / "tool.exe", "MZ")
    write(d / "fake.parquet", "not parquet")
    got = {r["path"].rsplit("/", 1)[1]: r for r in inventory.profile_files(spark, str(d)).collect()}
    assert got["empty.csv"]["errors"][0] == "file is empty" and not got["empty.csv"]["passed"]
    one = got["one.csv"]
    assert one["passed"] and (one["delimiter"], one["rows"], one["header"]) == (";", 1, ["a", "b"])
    assert got["uneven.csv"]["uneven_rows"] == 2 and not got["uneven.csv"]["passed"]
    quoted = got["quoted.csv"]
    assert quoted["passed"] and quoted["multi_line"] and quoted["rows"] == 2 and quoted["header"] == ["a,1", "b"]
    assert got["latin.csv"]["errors"] == ["not valid UTF-8"]
    assert got["list.json"]["rows"] == 3 and got["list.json"]["passed"]
    assert got["broken.json"]["errors"] == ["invalid JSON"]
    assert got["tool.exe"]["errors"] == ["unsupported file format"]
    checks = {r["file_name"]: r["errors"] for r in inventory.validate_files(spark, str(d), max_bytes=30).collect()}
    assert checks["tool.exe"] == ["file type not allowed"] and checks["one.csv"] == []
    assert checks["fake.parquet"] == ["content does not match extension"] and checks["empty.csv"] == ["file is empty"]
    big = inventory.validate_files(spark, str(d), max_bytes=5).where("file_name = 'one.csv'").first()
    assert big["errors"] == []
    assert inventory.validate_files(spark, str(d), max_bytes=3).where("file_name = 'one.csv'").first()["errors"] == ["file too large"]


def test_preview(spark, tmp_path):
    d = tmp_path / "p"
    write(d / "bad.csv", "a\n" + "x" * 2000 + "<script>1</script>\n")
    write(d / "good.csv", "a\nfine\n")
    whole = {r[0].rsplit("/", 1)[1]: r[1] for r in inventory.malicious_preview(spark, str(d)).collect()}
    assert whole == {"bad.csv": True, "good.csv": False}
    start = inventory.malicious_preview(spark, str(d), preview_chars=1000).collect()
    assert not any(r["malicious"] for r in start)


# --- store and exports ------------------------------------------------------------------


def test_store_pages_and_exports(spark, tmp_path):
    df = spark.createDataFrame([(i, f"=cmd{i}" if i % 2 else "señor") for i in range(25)], "k int, t string")
    store = str(tmp_path / "store")
    source = sinks.write_parquet(df, str(tmp_path / "src"))
    assert records.load_parquet(spark, source, "t1", ["k"], store) == 25
    assert records.load_parquet(spark, source, "t2", ["k"], store) == 25
    page = jobs.results(spark, store, "t1", limit=10, offset=20)
    assert [r["record_index"] for r in page.collect()] == [20, 21, 22, 23, 24]
    assert page.first()["total_records"] == 25
    with pytest.raises(ValueError):
        jobs.results(spark, store, "t1", limit=10_001)
    data = records.parse_payload(records.read_records(spark, store, "t2", 3), "k int, t string")
    out = sinks.export(data, str(tmp_path / "csv"), "csv")
    assert sorted(r["t"] for r in spark.read.option("header", True).csv(out).collect()) == ["'=cmd1", "señor", "señor"]
    out = sinks.export(data, str(tmp_path / "json"), "json")
    assert "señor" in " ".join(r[0] for r in spark.read.text(out).collect())
    with pytest.raises(LookupError):
        sinks.export(data.limit(0), str(tmp_path / "none"), "csv")
    with pytest.raises(ValueError):
        sinks.export(data, str(tmp_path / "none"), "xlsx")
    pruned = records.read_records(spark, store, "t1", 1000)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(task_id" in pruned and "LessThan(record_index,1000)" in pruned


# --- jobs -------------------------------------------------------------------------------


def test_ingest_twice_reports_drift(spark, tmp_path):
    first = write(tmp_path / "a" / "f.csv", "User Id,NPS,Comment\n1,9,ok\n2,3,bad,extra\n")
    second = write(tmp_path / "b" / "f.csv", 'User Id,NPS,Region\n3,9,"x\ny"\n')
    history = str(tmp_path / "h")
    one = jobs.ingest(spark, first, str(tmp_path / "o1"), history)
    assert (one.rows, one.malformed, one.drift) == (1, 1, None)
    assert one.good(spark).columns == ["user_id", "nps", "comment"]
    assert one.quarantined(spark).count() == 1
    audit = one.audit.first()
    assert audit["rows"] == 1 and audit["status"] == "passed" and audit["unmapped_count"] == 1
    two = jobs.ingest(spark, second, str(tmp_path / "o2"), history)
    assert two.good(spark).first()["region"] == "x\ny"
    assert {r["field"]: r["change"] for r in two.drift.collect()} == {"comment": "removed", "region": "added"}
    log = spark.read.json(f"{history}/new_headers")
    assert sorted(r["header"] for r in log.collect()) == ["comment", "region"]
    again = jobs.ingest(spark, second, str(tmp_path / "o4"), history, profile_bytes=3)
    assert again.good(spark).first()["region"] == "x\ny" and again.drift.count() == 0
    with pytest.raises(ValueError, match="empty"):
        jobs.ingest(spark, write(tmp_path / "c" / "f.csv", ""), str(tmp_path / "o3"), history)


def test_ingest_of_files_with_different_layouts(spark, tmp_path):
    """Another order of columns, another separator, quoted line breaks and another encoding."""
    folder = tmp_path / "mixed"
    write(folder / "a.csv", "user,score\nu1,1\nu2,2\n")
    write(folder / "b.csv", "score,user\n3,u3\n")
    write(folder / "c.csv", "user;score;note\nu4;4;x,y\n")
    write(folder / "d.csv", 'user,score,note\nu5,5,"two\nlines"\n')
    write(folder / "e.csv", "user,score\nu6é,6\n".encode("utf-16"))
    out = jobs.ingest(spark, str(folder), str(tmp_path / "o"), str(tmp_path / "h"), canonical={"unused": ["unused"]})
    assert (out.rows, out.malformed) == (6, 0)
    rows = sorted((r["user"], r["score"], r["note"]) for r in out.good(spark).collect())
    assert rows == [("u1", "1", None), ("u2", "2", None), ("u3", "3", None), ("u4", "4", "x,y"), ("u5", "5", "two\nlines"), ("u6é", "6", None)]
    parted = jobs.ingest(spark, str(folder), str(tmp_path / "o2"), str(tmp_path / "h2"), canonical={"unused": ["unused"]}, partition_by=["user"])
    assert parted.good(spark).where("user = 'u3'").first()["score"] == "3"
    written = spark.read.parquet(parted.output).where("user = 'u3'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(user" in written


def test_ingest_of_json_layouts(spark, tmp_path):
    folder = tmp_path / "json"
    write(folder / "list.json", '[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]')
    write(folder / "lines.json", '{"b": "z", "a": 3}\n{"a": 4}\n')
    out = jobs.ingest(spark, str(folder), str(tmp_path / "o"), str(tmp_path / "h"), fmt="json", canonical={"unused": ["unused"]})
    assert sorted((r["a"], r["b"]) for r in out.good(spark).collect()) == [("1", "x"), ("2", "y"), ("3", "z"), ("4", None)]
    bad = tmp_path / "bad"
    write(bad / "rest.json", '{"a": 1} rubbish')
    with pytest.raises(ValueError, match="invalid JSON"):
        jobs.ingest(spark, str(bad), str(tmp_path / "o2"), str(tmp_path / "h2"), fmt="json")


def test_json_document_has_nothing_behind_it(spark):
    texts = ['{"a": 1}', '{"a": 1}\n{"a": 2}', '{"a": 1} x', "[1] [2]", "[1, 2]", " 5 ", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["p"] is None for r in df.select("i", inventory.json_problem(F.col("t")).alias("p")).orderBy("i").collect()]
    assert got == [True, False, False, False, True, True, False, False]


def test_second_load_goes_on(spark, tmp_path):
    source, store = str(tmp_path / "s"), str(tmp_path / "store")
    spark.range(7).write.parquet(source)
    assert records.load_parquet(spark, source, "t", ["id"], store) == 7
    assert records.load_parquet(spark, source, "t", ["id"], store) == 14
    found = records.read_records(spark, store, "t")
    assert sorted(r["record_index"] for r in found.collect()) == list(range(14))
    assert records.page(found, 5, 5).count() == 5


def test_convert(spark, tmp_path):
    df = spark.createDataFrame(
        [(" Basic ", 9, "si", "<iframe src=vbscript:go('b')>", "15/01/2024"),
         ("Basic", 9, "no", "@HOY(B2)", "2024-01-16"), ("Basic", 9, "quizás", "ok", "x")] * 2
        + [("Basic", 1, "1", None, "2024-02-01")] * 14,
        "plan string, score int, outage_flag string, comentario string, fecha string")
    result = jobs.convert(spark, df, str(tmp_path / "out"))
    assert result.types["outage_flag"] == "boolean" and result.types["fecha"] == "date"
    rows = spark.read.parquet(result.output)
    assert dict(rows.dtypes)["outage_flag"] == "boolean"
    comments = {r["comentario"] for r in rows.collect()}
    assert comments == {"&lt;iframe src=go(b)&gt;", "'@HOY(B2)", "ok", None}
    report = {(r["phase"], r["metric"]): r["value"] for r in result.quality.where("column IS NULL").collect()}
    assert report[("improvements", "whitespace_cleaned")] == 2.0
    assert report[("after", "duplicate_rows")] == 20 - 4
    assert {r["column"]: r["blocked"] for r in result.blocked.collect()}["comentario"] == 2


def test_sentiment_stage_is_persistable(spark, tmp_path):
    df = spark.createDataFrame([("good", 1), ("bad", 0)] * 20, "text string, label int")
    sentiment.train(df).save(str(tmp_path / "m"))
    SentimentTransformer(inputCol="words", modelPath=str(tmp_path / "m")).save(str(tmp_path / "s"))
    stage = SentimentTransformer.load(str(tmp_path / "s"))
    scored = stage.transform(df.select(F.col("text").alias("words")))
    assert scored.columns == ["words", "sentiment", "confidence", "positive_score", "negative_score"]
    assert {r["words"]: r["sentiment"] for r in scored.collect()} == {"good": "POSITIVE", "bad": "NEGATIVE"}


# --- streams ----------------------------------------------------------------------------


def run(df, out, state):
    df.writeStream.format("parquet").option("checkpointLocation", state).option("path", out) \
        .trigger(availableNow=True).start().awaitTermination()


def test_stream_limiter_equals_batch_across_batches(spark, tmp_path):
    rule = limits.BucketRule(3, 0.3)
    events = spark.createDataFrame([(i, f"k{i % 3}", i * 700_000) for i in range(120)], "i long, k string, us long") \
        .select("i", "k", F.timestamp_micros("us").alias("ts"))
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for lo in (0, 40, 80):
        events.where((F.col("i") >= lo) & (F.col("i") < lo + 40)).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(events.schema).parquet(src)
        run(token_bucket_stream(stream, "k", "ts", "i", rule), out, state)
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("i", "allowed", "retry_after", "tokens_left").collect())
    batch = limits.token_bucket(events, "k", "ts", "i", rule)
    want = sorted(tuple(r) for r in batch.select("i", "allowed", "retry_after", "tokens_left").collect())
    assert got == want and len({a for _, a, _, _ in got}) == 2


def test_stream_windows_equal_batch(spark, tmp_path):
    log = spark.range(500).select(
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"),
        (F.col("id") % 2).alias("layer"), (F.col("id") % 7).cast("double").alias("seconds"))
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for lo in (0, 250):
        log.where((F.col("seconds") >= 0) & (F.minute("ts") >= 0)).where(
            F.unix_timestamp("ts").between(1704067200 + lo * 60, 1704067200 + (lo + 249) * 60)) \
            .coalesce(1).write.mode("append").parquet(src)
        run(windowed_rollup(spark.readStream.schema(log.schema).parquet(src), "ts", ["layer"], "seconds"), out, state)
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    want = {tuple(r) for r in windowed_rollup(log, "ts", ["layer"], "seconds").collect()}
    assert got < want and len(got) == 2 * 8


def test_file_stream_ingests_each_file_once(spark, tmp_path):
    drop, out, state, audit = (str(tmp_path / n) for n in ("drop", "out", "state", "audit"))
    for n, content in (("a.csv", "x,y\n1, a\n2,b,c\n"), ("b.csv", "x,y\n3,d\n")):
        write(tmp_path / "drop" / n, content)
        stream_files.ingest_stream(spark, drop, ["x", "y"], out, state, audit_path=audit).awaitTermination()
    rows = {(r["x"], r["y"], r["row_status"], r["batch_id"]) for r in spark.read.parquet(out).collect()}
    assert {r for r in rows if r[2] == "good"} == {("1", " a", "good", 0), ("3", "d", "good", 1)}
    assert len(rows) == 3
    assert sorted(r["rows"] for r in spark.read.json(audit).collect()) == [1, 1]


# --- plans ------------------------------------------------------------------------------


def test_profile_is_one_scan_and_pruned(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus")
    for report in (quality.quality_report(orders), schema.detect_schema(orders), quality.quality_issues(orders),
                   quality.before_after_report(orders, schema.cleaning_columns(orders, {}))):
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and "o_totalprice" not in plan


def test_scratch_is_reused(spark):
    assert scratch_root(spark) == scratch_root(spark)


def test_no_task_gathers_a_language(spark, tmp_path, monkeypatch):
    from claravoz.catalog import files

    rows = [(i, "es" if i % 3 else "en", "<script>x</script>" if i == 1 else f"text, {i}\n") for i in range(4_000)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(files, "scratch_path", lambda spark, label: str(tmp_path / label))
    found = {r["lang"]: r["malicious"] for r in files.malicious_files(spark, str(tmp_path)).collect()}
    assert found == {"es": True, "en": False}
    assert len(list((tmp_path / "per-lang" / "lang=es").glob("*.csv"))) == 4
