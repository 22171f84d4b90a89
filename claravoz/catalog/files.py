"""Queries for sources, sinks, file checks, headers, schema records and the record store.

The given tables are written to the scratch folder in raw formats first, so
that scans and checks run over files Spark derived from them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from claravoz.catalog import survey as sv
from claravoz.catalog.registry import query, table
from claravoz.catalog.survey import SURVEY_SQL, survey
from claravoz.functions import text
from claravoz.operators import headers, schema, schema_rows
from claravoz.plans import jobs
from claravoz.scratch import scratch_path
from claravoz.sources import inventory, readers, records, sinks

_CUSTOMER_TEXT = """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
    CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer"""


def _written(spark, d, name, fmt, **options):
    path = scratch_path(spark, f"{name}-{fmt}")
    table(spark, d, name).write.format(fmt).options(**options).save(path)
    return path


def _documents_csv(spark, d):
    """(path, options to read it): texts as CSV that keeps every character, and null and empty apart.

    Spark's writer trims cells and writes null like an empty text unless told otherwise; null
    is written as a mark that no text holds. The parser drops NUL unless quotes have an escape.
    """
    path, null = scratch_path(spark, "documents-csv"), uuid.uuid4().hex
    table(spark, d, "documents").select("doc_id", "lang", "text").write.options(
        header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        nullValue=null).csv(path)
    return path, {"nullValue": null, "charToEscapeQuoteEscaping": '"'}


@query("raw_csv_scan", _CUSTOMER_TEXT)
def raw_csv_scan(spark, d):
    return readers.read_raw(spark, _written(spark, d, "customer", "csv", header=True))


@query("raw_csv_multiline", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, text FROM documents")
def raw_csv_multiline(spark, d):
    path, options = _documents_csv(spark, d)
    return readers.read_raw(spark, path, options={"ignoreLeadingWhiteSpace": "false", **options})


@query("raw_json_scan", _CUSTOMER_TEXT)
def raw_json_scan(spark, d):
    return readers.read_raw(spark, _written(spark, d, "customer", "json"), "json").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("format_scan", "SELECT * FROM supplier")
def format_scan(spark, d):
    return readers.read_raw(spark, _written(spark, d, "supplier", "orc"), "orc")


@query("inferred_schema", """SELECT * FROM (VALUES ('c_custkey', 'integer'), ('c_name', 'string'), ('c_nationkey',
       'integer'), ('c_acctbal', 'double'), ('c_mktsegment', 'string')) AS t(field, type)""")
def inferred_schema(spark, d):
    found = schema.infer_schema_json(spark, _written(spark, d, "customer", "csv", header=True))
    one = spark.range(1).select(F.from_json(F.lit(found), "fields array<struct<name:string,type:string>>").alias("s"))
    return one.select(F.explode("s.fields").alias("f")).select(
        F.col("f.name").alias("field"), F.col("f.type").alias("type"))


@query("typed_scan", """SELECT CAST(CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey END AS INTEGER) AS c_custkey,
       c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer""")
def typed_scan(spark, d):
    key = F.col("c_custkey")
    path = scratch_path(spark, "customer-dirty")
    table(spark, d, "customer").select(
        F.when(key % 6 == 0, "n/a").otherwise(key.cast("string")).alias("c_custkey"), "c_name",
        F.when(key % 5 == 0, "?").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
    ).write.options(header=True).csv(path)
    kinds = T.StructType([T.StructField("c_custkey", T.IntegerType()), T.StructField("c_name", T.StringType()),
                          T.StructField("c_acctbal", T.DoubleType())])
    return readers.read_typed(spark, path, kinds)


@query("corrupt_file_tolerance", "SELECT n_nationkey, n_name FROM nation")
def corrupt_file_tolerance(spark, d):
    good, bad = _written(spark, d, "nation", "parquet"), scratch_path(spark, "not-parquet")
    table(spark, d, "nation").select("n_name").write.text(bad)
    read = readers.read_raw(spark, [good, bad], "parquet", {"pathGlobFilter": "part-*"}, ignore_corrupt_files=True,
                            schema="n_nationkey int, n_name string")
    return read.select("n_nationkey", "n_name")


def _ragged(spark, d):
    """Customer rows as CSV lines; some with a field too many, some cut short."""
    key = F.col("c_custkey")
    line = F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment")
    line = F.when(key % 9 == 0, F.concat(line, F.lit(",extra"))).when(key % 10 == 0, key.cast("string")).otherwise(line)
    path = scratch_path(spark, "customer-ragged")
    table(spark, d, "customer").select(line.alias("value")).write.text(path)
    return readers.read_raw(spark, path, options={"header": "false", "multiLine": "false"},
                            columns=["c_custkey", "c_name", "c_mktsegment"], corrupt=True)


@query("quarantine_good", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer
       WHERE c_custkey % 9 <> 0 AND c_custkey % 10 <> 0""")
def quarantine_good(spark, d):
    return sinks.quarantine(_ragged(spark, d), scratch_path(spark, "quarantine"))


@query("quarantine_malformed", """SELECT CASE WHEN c_custkey % 9 = 0 THEN c_custkey || ',' || c_name || ',' ||
       c_mktsegment || ',extra' ELSE CAST(c_custkey AS VARCHAR) END AS record FROM customer
       WHERE c_custkey % 9 = 0 OR c_custkey % 10 = 0""")
def quarantine_malformed(spark, d):
    path = scratch_path(spark, "quarantine")
    sinks.quarantine(_ragged(spark, d), path)
    return spark.read.parquet(path).select(F.col(readers.CORRUPT).alias("record"))


@query("parquet_snappy_sink", "SELECT * FROM orders")
def parquet_snappy_sink(spark, d):
    return spark.read.parquet(sinks.write_parquet(table(spark, d, "orders"), scratch_path(spark, "orders")))


@query("parquet_zstd_sink", "SELECT * FROM events")
def parquet_zstd_sink(spark, d):
    return spark.read.parquet(sinks.write_parquet(
        table(spark, d, "events"), scratch_path(spark, "events"), "zstd"))


@query("partitioned_sink", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def partitioned_sink(spark, d):
    path = sinks.write_table(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"),
                             scratch_path(spark, "orders"), ["o_orderstatus"])
    return spark.read.schema("o_orderkey long, o_totalprice double, o_orderstatus string").parquet(path)


@query("csv_export", f"""WITH {SURVEY_SQL} SELECT CAST(answer_id AS VARCHAR) AS answer_id,
       {sv.formula_sql('comentario')} AS comentario, {sv.formula_sql('plan')} AS plan FROM survey""")
def csv_export(spark, d):
    path = sinks.export_csv(survey(spark, d).select("answer_id", "comentario", "plan"), scratch_path(spark, "export"))
    return readers.read_raw(spark, path)


@query("json_export", f"""WITH {SURVEY_SQL} SELECT answer_id, comentario, pain_points, "NOTA" FROM survey""")
def json_export(spark, d):
    path = sinks.export_json(survey(spark, d).select("answer_id", "comentario", "pain_points", "NOTA"),
                             scratch_path(spark, "export"))
    return spark.read.schema("answer_id long, comentario string, pain_points string, NOTA int").json(path)


@query("export_dispatch", """SELECT d.doc_id AS record_id, d.lang, CASE WHEN l.quality = 1 THEN 'POSITIVE'
       WHEN l.quality = 0 THEN 'NEGATIVE' END AS sentiment, 0.75::DOUBLE + l.toxic / 8.0::DOUBLE AS confidence
       FROM documents d LEFT JOIN labels l USING (doc_id)""")
def export_dispatch(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), "lang")
    path = sinks.export(docs, scratch_path(spark, "export"), "json", sentiments=_sentiments(spark, d))
    return spark.read.schema("record_id long, lang string, sentiment string, confidence double").json(path)


def _sentiments(spark, d):
    """Labels as stored sentiment results."""
    score = F.lit(0.75) + F.col("toxic") / 8
    return table(spark, d, "labels").select(
        F.col("doc_id").alias("record_id"), F.when(F.col("quality") == 1, "POSITIVE").otherwise("NEGATIVE").alias("sentiment"),
        score.alias("confidence"), F.when(F.col("quality") == 1, score).otherwise(1 - score).alias("positive_score"),
        F.when(F.col("quality") == 1, 1 - score).otherwise(score).alias("negative_score"))


@query("history_append", "SELECT o_custkey AS source, count(*) AS rows FROM orders GROUP BY o_custkey UNION ALL "
       "SELECT -c_nationkey, count(*) FROM customer GROUP BY c_nationkey")
def history_append(spark, d):
    path = scratch_path(spark, "history")
    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("source"))
    second = table(spark, d, "customer").groupBy((-F.col("c_nationkey")).cast("long").alias("source"))
    for part in (first, second):
        sinks.append_history(part.agg(F.count(F.lit(1)).alias("rows")), path)
    return spark.read.schema("source long, rows long").json(path)


@query("unmapped_header_log", "SELECT DISTINCT p_name AS header FROM part UNION SELECT DISTINCT p_type FROM part")
def unmapped_header_log(spark, d):
    path, part = scratch_path(spark, "headers"), table(spark, d, "part")
    names, kinds = (part.select(F.col(c).alias("header")) for c in ("p_name", "p_type"))
    headers.log_new_headers(names, path)
    return headers.log_new_headers(kinds.unionByName(names), path)


@query("enrichment_tables", """SELECT vec_id AS record_id, label, CAST(embedding[1] AS DOUBLE) AS head,
       len(embedding) AS size FROM embeddings""")
def enrichment_tables(spark, d):
    path = scratch_path(spark, "vectors")
    sinks.write_enrichment(table(spark, d, "embeddings").withColumnRenamed("vec_id", "record_id"), path)
    return spark.read.parquet(path).select(
        "record_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("head"),
        F.size("embedding").cast("long").alias("size"))


# --- record store -----------------------------------------------------------------------

_RECORDS_SQL = """r AS (SELECT 'docs' AS task_id, row_number() OVER (ORDER BY doc_id) - 1 AS record_index,
    doc_id, text, lang, source, n_chars FROM documents)"""


@query("record_load", f"""WITH {_RECORDS_SQL} SELECT task_id, record_index, CAST(to_json({{'doc_id': doc_id, 'text': text,
       'lang': lang, 'source': source, 'n_chars': n_chars}}) AS VARCHAR) AS data FROM r""")
def record_load(spark, d):
    return records.to_records(table(spark, d, "documents"), "docs", ["doc_id"])


def _store(spark, d):
    path = scratch_path(spark, "store")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    # the task is loaded twice, as files arrive
    early = F.col("o_orderkey") <= orders.agg(F.expr("percentile_approx(o_orderkey, 0.4)")).first()[0]
    records.write_records(records.to_records(orders.where(early), "orders", ["o_orderkey"]), path)
    first = records.next_index(spark, path, "orders")
    records.write_records(records.to_records(orders.where(~early), "orders", ["o_orderkey"], first), path)
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    records.write_records(records.to_records(nation, "nation", ["n_nationkey"]), path)
    return path


_ORDER_RECORDS_SQL = """r AS (SELECT 'orders' AS task_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS record_index,
    o_orderkey, o_orderstatus, o_totalprice FROM orders)"""


@query("record_scan", f"WITH {_ORDER_RECORDS_SQL} SELECT * FROM r")
def record_scan(spark, d):
    found = records.read_records(spark, _store(spark, d), "orders")
    return records.parse_payload(found, "o_orderkey long, o_orderstatus string, o_totalprice double")


@query("paged_results", f"""WITH {_ORDER_RECORDS_SQL} SELECT record_index, o_orderkey, (SELECT count(*) FROM orders)
       AS total_records FROM r WHERE record_index >= 250 AND record_index < 350""")
def paged_results(spark, d):
    wanted = jobs.results(spark, _store(spark, d), "orders", limit=100, offset=250)
    return records.parse_payload(wanted, "o_orderkey long").select("record_index", "o_orderkey", "total_records")


@query("index_within_task", """SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority
       ORDER BY o_orderdate, o_orderkey) - 1 AS record_index FROM orders""")
def index_within_task(spark, d):
    from claravoz.operators.ordering import number_rows

    orders = table(spark, d, "orders").select("o_orderpriority", "o_orderdate", "o_orderkey")
    return number_rows(orders, ["o_orderdate", "o_orderkey"], ["o_orderpriority"]).drop("o_orderdate")


@query("records_with_sentiment", """SELECT d.doc_id AS record_id, d.lang, CASE WHEN l.quality = 1 THEN 'POSITIVE'
       WHEN l.quality = 0 THEN 'NEGATIVE' END AS sentiment FROM documents d LEFT JOIN labels l USING (doc_id)""")
def records_with_sentiment(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), "lang")
    return records.with_sentiment(docs, _sentiments(spark, d)).select("record_id", "lang", "sentiment")


@query("sentiment_distribution", """SELECT CASE WHEN quality = 1 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sentiment,
       count(*) AS n FROM labels GROUP BY 1""")
def sentiment_distribution(spark, d):
    from claravoz.operators.feedback import sentiment_distribution as distribution

    return distribution(_sentiments(spark, d))


@query("task_statistics", """SELECT d.source AS task_id, count(*) AS total_records,
       count(*) FILTER (l.quality = 1) AS positive, count(*) FILTER (l.quality = 0) AS negative,
       round(avg(0.75::DOUBLE + l.toxic / 8.0::DOUBLE), 6) AS average_confidence
       FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""")
def task_statistics(spark, d):
    from claravoz.operators.feedback import task_statistics as statistics

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("task_id"))
    return statistics(docs, _sentiments(spark, d)).withColumn("average_confidence", F.round("average_confidence", 6))


# --- file checks ------------------------------------------------------------------------


def _per_nation(spark, d):
    """One CSV file of customers per nation."""
    path = scratch_path(spark, "per-nation")
    table(spark, d, "customer").repartition("c_nationkey").write.options(header=True, quoteAll=True) \
        .partitionBy("c_nationkey").csv(path)
    return path


def _nation():
    return F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int")


@query("file_inventory", "SELECT c_nationkey, 1::BIGINT AS files, 'csv' AS extension, true AS known_size FROM customer GROUP BY c_nationkey")
def file_inventory(spark, d):
    files = inventory.file_inventory(spark, _per_nation(spark, d))
    return files.groupBy(_nation().alias("c_nationkey")).agg(
        F.count(F.lit(1)).alias("files"), F.max("extension").alias("extension"),
        (F.min("size_bytes") > 0).alias("known_size"))


@query("file_profile", """SELECT c_nationkey, CAST(count(*) + 1 AS INTEGER) AS rows, ',' AS delimiter, 'utf-8' AS encoding,
       'c_custkey|c_name|c_acctbal|c_mktsegment' AS header, 0::INTEGER AS uneven_rows, false AS multi_line, true AS passed
       FROM customer GROUP BY c_nationkey""")
def file_profile(spark, d):
    return inventory.profile_files(spark, _per_nation(spark, d)).select(
        _nation().alias("c_nationkey"), "rows", "delimiter", "encoding", F.array_join("header", "|").alias("header"),
        "uneven_rows", "multi_line", "passed")


def _mixed(spark, d):
    """CSV files of customers by nation in several layouts: semicolons, rows of other lengths, quoted
    line breaks, Latin-1."""
    root, customer = scratch_path(spark, "mixed"), table(spark, d, "customer")
    columns = customer.repartition("c_nationkey").select("c_nationkey", "c_custkey", "c_name", "c_mktsegment")
    columns.write.options(header=True, sep=";").partitionBy("c_nationkey").csv(f"{root}/kind=semicolon")
    line = F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "extra"))
    header = customer.select("c_nationkey").distinct().select("c_nationkey", F.lit(-1).cast("long").alias("n"), F.lit("key,name,segment").alias("value"))
    # of the table as it is: a union of sides that are dealt by nation already would not be dealt again, though the sides' tasks differ
    ragged = customer.select("c_nationkey", F.col("c_custkey").cast("long").alias("n"), line.alias("value")).unionByName(header)
    ragged.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "n").select("c_nationkey", "value") \
        .write.partitionBy("c_nationkey").text(f"{root}/kind=ragged")
    columns.withColumn("c_name", F.concat("c_name", F.lit(",\n"), "c_mktsegment")).write.options(header=True, quoteAll=True) \
        .partitionBy("c_nationkey").csv(f"{root}/kind=breaks")
    columns.withColumn("c_name", F.concat(F.lit("ñ"), "c_name")).write.options(header=True, encoding="ISO-8859-1") \
        .partitionBy("c_nationkey").csv(f"{root}/kind=latin")
    return root


_MIXED_SQL = """n AS (SELECT c_nationkey, CAST(count(*) + 1 AS INTEGER) AS rows,
    CAST(count(*) FILTER (c_custkey % 7 = 0) AS INTEGER) AS uneven FROM customer GROUP BY c_nationkey),
    k AS (SELECT * FROM (VALUES ('semicolon', ';', 'utf-8', false), ('ragged', ',', 'utf-8', false), ('breaks', ',', 'utf-8', true),
    ('latin', ',', 'iso-8859-1', false)) AS v(kind, delimiter, encoding, multi_line))"""


@query("file_profile_mixed", f"""WITH {_MIXED_SQL}, m AS (SELECT *, CASE WHEN kind = 'ragged' THEN uneven ELSE 0 END AS uneven_rows FROM n, k)
       SELECT kind, c_nationkey, rows, delimiter, encoding, uneven_rows, multi_line,
       CASE WHEN uneven_rows > 0 THEN uneven_rows || ' rows differ from the header in length' ELSE '' END AS errors,
       uneven_rows = 0 AS passed FROM m""")
def file_profile_mixed(spark, d):
    """Profile by ranges of 2,000 bytes, so that quotes, rows and characters cross them."""
    found = inventory.profile_files(spark, _mixed(spark, d), single_byte=True, range_bytes=2_000)
    return found.select(F.regexp_extract("path", "kind=([a-z]+)", 1).alias("kind"), _nation().alias("c_nationkey"), "rows", "delimiter", "encoding",
                        "uneven_rows", "multi_line", F.array_join("errors", ";").alias("errors"), "passed")


@query("file_validation_mixed", f"""WITH {_MIXED_SQL} SELECT kind, c_nationkey,
       CASE WHEN kind = 'latin' THEN 'content does not match extension' ELSE '' END AS errors FROM n, k""")
def file_validation_mixed(spark, d):
    found = inventory.validate_files(spark, _mixed(spark, d))
    return found.select(F.regexp_extract("path", "kind=([a-z]+)", 1).alias("kind"), _nation().alias("c_nationkey"),
                        F.array_join("errors", ";").alias("errors"))


@query("csv_range_scan", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, text FROM documents")
def csv_range_scan(spark, d):
    """Multi-line records read by many tasks, each from its range of bytes."""
    path, options = _documents_csv(spark, d)
    return readers.read_ranges(spark, path, range_bytes=1 << 16, options=options).drop(readers.CORRUPT)


@query("file_validation", "SELECT c_nationkey, 'csv' AS extension, true AS passed FROM customer GROUP BY c_nationkey")
def file_validation(spark, d):
    return inventory.validate_files(spark, _per_nation(spark, d)).select(
        _nation().alias("c_nationkey"), "extension", "passed")


@query("json_well_formed", """WITH j AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN substr(props, 1, length(props) - 1)
       WHEN event_id % 10 = 1 THEN '[' || props || ',' || props || ']' ELSE props END AS document FROM events)
       SELECT event_id, CASE WHEN NOT json_valid(document) THEN 'invalid JSON' END AS problem,
       CAST(CASE WHEN json_valid(document) THEN json_array_length(document) ELSE 0 END AS INTEGER) AS rows FROM j""")
def json_well_formed(spark, d):
    key, props = F.col("event_id"), F.col("props")
    document = (
        F.when(key % 10 == 0, F.expr("left(props, length(props) - 1)"))
        .when(key % 10 == 1, F.concat(F.lit("["), props, F.lit(","), props, F.lit("]"))).otherwise(props)
    )
    return table(spark, d, "events").select(
        "event_id", inventory.json_problem(document).alias("problem"), inventory.json_rows(document).alias("rows"))


@query("malicious_files", """SELECT lang, bool_or(regexp_matches(text,
       '<script[^>]*>.*?</script>|<iframe[^>]*>.*?</iframe>|javascript:|onerror=|onload=', 'i')) AS malicious
       FROM documents GROUP BY lang""")
def malicious_files(spark, d):
    path = scratch_path(spark, "per-lang")
    # each task writes its rows of every language: no task gathers a language
    table(spark, d, "documents", spread=True).select("lang", "text").write.options(header=True).partitionBy("lang").csv(path)
    return inventory.malicious_preview(spark, path).groupBy(
        F.regexp_extract("path", r"lang=(\w+)", 1).alias("lang")).agg(F.bool_or("malicious").alias("malicious"))


@query("file_name_safety", r"""SELECT page_id, concat_ws('|', CASE WHEN contains(url, '..') OR contains(url, '/') OR
       contains(url, '\') THEN 'path traversal' END, CASE WHEN length(url) > 255 THEN 'too long' END) AS problems,
       regexp_replace(split_part(url, '/', -1), '[^\p{L}\p{N}._\-]', '_', 'g') AS safe_name FROM pages""")
def file_name_safety(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.array_join(text.file_name_problems(F.col("url")), "|").alias("problems"),
        text.safe_file_name(F.col("url")).alias("safe_name"))


# --- headers and schema -----------------------------------------------------------------

PART_CANONICAL = {
    "ring": ["ring", "loop"], "widget": ["widget", "wdgt"], "bolt": ["bolt", "screw"], "colour": ["red", "blu"],
}


def _header_rows(spark, d):
    """Part names and segments as headers of many files."""
    part = table(spark, d, "part").select(F.initcap("p_name").alias("header"))
    segment = table(spark, d, "customer").select(F.concat(F.lit(" "), "c_mktsegment", F.lit("  Id")).alias("header"))
    return part.unionByName(segment).distinct()


_HEADERS_SQL = """h AS (SELECT DISTINCT * FROM (SELECT upper(substr(split_part(p_name, ' ', 1), 1, 1)) ||
    substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) ||
    substr(split_part(p_name, ' ', 2), 2) AS header FROM part UNION ALL SELECT ' ' || c_mktsegment || '  Id' FROM customer)),
    n AS (SELECT header, regexp_replace(trim(lower(header)), '\\s+', '_', 'g') AS normalized FROM h)"""


@query("header_normalize", f"WITH {_HEADERS_SQL} SELECT * FROM n")
def header_normalize(spark, d):
    return _header_rows(spark, d).select("header", text.header_name(F.col("header")).alias("normalized"))


_ALIASES = [(t, a) for t, names in PART_CANONICAL.items() for a in (t, *names)]
_ALIAS_SQL = "a AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{t}', '{a}')" for i, (t, a) in enumerate(_ALIASES)) + ") AS v(pos, target, alias))"


@query("alias_match_contains", f"""WITH {_HEADERS_SQL}, {_ALIAS_SQL} SELECT header, arg_min(target, pos) AS target FROM n
       LEFT JOIN a ON contains(normalized, alias) OR contains(alias, normalized) GROUP BY header""")
def alias_match_contains(spark, d):
    name = text.header_name(F.col("header"))
    return _header_rows(spark, d).select(
        "header", headers.alias_match(name, PART_CANONICAL, "contains").alias("target"))


@query("alias_match_tokens", f"""WITH {_HEADERS_SQL}, {_ALIAS_SQL} SELECT header, arg_min(target, pos) AS target FROM n
       LEFT JOIN a ON contains('_' || normalized || '_', '_' || alias || '_')
       OR contains('_' || alias || '_', '_' || normalized || '_') GROUP BY header""")
def alias_match_tokens(spark, d):
    name = text.header_name(F.col("header"))
    return _header_rows(spark, d).select("header", headers.alias_match(name, PART_CANONICAL).alias("target"))


@query("fuzzy_match", f"""WITH {_HEADERS_SQL}, {_ALIAS_SQL}, p AS (SELECT header, pos, target,
       CASE WHEN length(normalized) <= length(alias) THEN normalized ELSE alias END AS s,
       CASE WHEN length(normalized) <= length(alias) THEN alias ELSE normalized END AS l FROM n, a),
       w AS (SELECT header, pos, target, s, unnest(range(1, length(l) - length(s) + 2)) AS i, l FROM p),
       m AS (SELECT header, pos, target, (1.0::DOUBLE - min(levenshtein(substr(l, i, length(s)), s)) / any_value(length(s))::DOUBLE)
         * 100 AS score FROM w GROUP BY header, pos, target),
       b AS (SELECT header, target, score, row_number() OVER (PARTITION BY header ORDER BY score DESC, pos) AS r FROM m)
       SELECT header, CASE WHEN score >= 75 THEN target END AS target FROM b WHERE r = 1""")
def fuzzy_match(spark, d):
    name = text.header_name(F.col("header"))
    return _header_rows(spark, d).select("header", headers.fuzzy_match(name, PART_CANONICAL, 75).alias("target"))


@query("header_mapping", f"""WITH {_HEADERS_SQL}, {_ALIAS_SQL}, m AS (SELECT header, normalized, arg_min(target, pos) AS t
       FROM n LEFT JOIN a ON contains(normalized, alias) OR contains(alias, normalized) GROUP BY header, normalized)
       SELECT header, coalesce(t, regexp_replace(normalized, '[^\\p{{L}}\\p{{N}}_]+', '_', 'g')) AS target,
       CASE WHEN t IS NULL THEN 'unmapped' ELSE 'alias' END AS method FROM m""")
def header_mapping(spark, d):
    name = text.header_name(F.col("header"))
    return _header_rows(spark, d).select(
        "header", headers.map_header(name, PART_CANONICAL, 101, "contains").alias("m")).select("header", "m.*")


@query("value_normalize", r"SELECT doc_id, trim(lower(regexp_replace(text, '[\t\n\x0B\f\r ]+', '_', 'g'))) AS text FROM documents")
def value_normalize(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("k"), "text")
    return docs.select(F.col("k").alias("doc_id"), text.normalize_value(F.col("text")).alias("text"))


@query("column_mapping_report", """SELECT column_name AS original, CASE column_name WHEN 'event_id' THEN 'user_id'
       WHEN 'user_id' THEN 'user_id_2' ELSE column_name END AS mapped, CASE column_name WHEN 'event_id' THEN 'mapped'
       WHEN 'user_id' THEN 'collision' ELSE 'unmapped' END AS status FROM (DESCRIBE events)""")
def column_mapping_report(spark, d):
    _, report = headers.map_columns(table(spark, d, "events"))
    return headers.mapping_report(spark, report).select("original", "mapped", "status")


@query("vector_header_suggestions")
def vector_header_suggestions(spark, d):
    known = {"small ring": ["ring"], "red widget": ["widget"], "blue bolt": ["bolt"], "automobile": ["car"]}
    return headers.suggest_by_vector(_header_rows(spark, d), known, 0.5)


@query("approve_pending", """WITH c AS (SELECT DISTINCT p_type AS target, p_name AS alias, '1' AS version FROM part
       WHERE p_size < 20), n AS (SELECT DISTINCT p_type AS target, p_name AS alias FROM part)
       SELECT * FROM c UNION ALL SELECT target, alias, '2' FROM n WHERE (target, alias) NOT IN (SELECT (target, alias) FROM c)""")
def approve_pending(spark, d):
    part = table(spark, d, "part").select(F.col("p_type").alias("target"), F.col("p_name").alias("alias"), "p_size")
    known = part.where("p_size < 20").select("target", "alias").distinct().withColumn("version", F.lit("1"))
    return headers.approve_pending(known, part, "2")


@query("schema_record", "SELECT 'orders' AS source_path, 'v7' AS version, string_agg(column_name, '|') AS fields, "
       "CAST(count(*) AS INTEGER) AS field_count FROM (DESCRIBE orders)")
def schema_record(spark, d):
    return schema.schema_record(table(spark, d, "orders"), "orders", "v7").select(
        "source_path", "version", F.array_join("fields", "|").alias("fields"), "field_count")


@query("schema_drift", """SELECT coalesce(n.f, o.f) AS field, CASE WHEN o.f IS NULL THEN 'added' ELSE 'removed' END AS change
       FROM (SELECT substr(column_name, 3) AS f FROM (DESCRIBE customer)) n
       FULL JOIN (SELECT substr(column_name, 3) AS f FROM (DESCRIBE supplier)) o ON n.f = o.f
       WHERE n.f IS NULL OR o.f IS NULL""")
def schema_drift(spark, d):
    def bare(name):
        df = table(spark, d, name)
        return schema.field_table(df.toDF(*(c[2:] for c in df.columns)))

    return schema.schema_drift(bare("customer"), bare("supplier")).select("field", "change")


@query("string_columns", "SELECT column_name AS field FROM (DESCRIBE customer) WHERE column_type = 'VARCHAR'")
def string_columns(spark, d):
    names = schema.string_columns(table(spark, d, "customer"))
    return schema.field_table(table(spark, d, "customer")).where(F.col("field").isin(names)).select("field")


# Orders as documents of two versions: the priority is renamed, the total turns into text in some, the state
# goes, and a status comes that has nothing to do with it.
_VERSIONS_SQL = """o AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'v1' ELSE 'v2' END AS version FROM orders),
    f AS (SELECT version, 'key' AS field, 'integer' AS kind, CAST(o_orderkey AS VARCHAR) AS value FROM o
    UNION ALL SELECT version, 'total', CASE WHEN version = 'v2' AND o_orderstatus = 'F' THEN 'string' ELSE 'float' END, CAST(o_totalprice AS VARCHAR) FROM o
    UNION ALL SELECT version, CASE WHEN version = 'v1' THEN 'priority' ELSE 'urgency' END, 'string', o_orderpriority FROM o
    UNION ALL SELECT version, CASE WHEN version = 'v1' THEN 'state' ELSE 'status' END, 'string',
      CASE WHEN version = 'v1' THEN o_orderstatus ELSE 'S' || (o_custkey % 7) END FROM o
    UNION ALL SELECT version, 'note', 'null', NULL FROM o),
    r AS (SELECT version, field, CASE WHEN count(DISTINCT kind) > 1 THEN 'mixed' ELSE min(kind) END AS type, count(*) AS rows,
      count(*) FILTER (kind = 'null') AS nulls, count(DISTINCT value) AS n FROM f GROUP BY version, field)"""


def _versions(spark, d):
    first = F.col("o_orderkey") % 2 == 0
    total = F.when(~first & (F.col("o_orderstatus") == "F"), F.concat(F.lit('"'), F.col("o_totalprice"), F.lit('"'))).otherwise(
        F.format_string("%.2f", "o_totalprice"))
    document = F.concat(
        F.lit('{"key": '), F.col("o_orderkey"), F.lit(', "total": '), total, F.when(first, ', "priority": "').otherwise(', "urgency": "'), F.col("o_orderpriority"),
        F.when(first, F.concat(F.lit('", "state": "'), F.col("o_orderstatus"))).otherwise(F.concat(F.lit('", "status": "S'), F.col("o_custkey") % 7)),
        F.lit('", "note": null}'))
    rows = table(spark, d, "orders").select(F.when(first, "v1").otherwise("v2").alias("version"), document.alias("document"))
    # two loads whose records are merged
    loads = [rows.where(F.crc32(F.col("document").cast("binary")) % 2 == k) for k in (0, 1)]
    parts = [schema_rows.field_record(load, "version", "document") for load in loads]
    return schema_rows.merged_records(parts[0].unionByName(parts[1]))


@query("schema_record_rows", f"WITH {_VERSIONS_SQL} SELECT version, field, type, rows, nulls, least(n, 1000) AS \"distinct\" FROM r")
def schema_record_rows(spark, d):
    return schema_rows.described(_versions(spark, d)).withColumn("distinct", F.least("distinct", F.lit(1000)))


@query("schema_drift_rows", f"""WITH {_VERSIONS_SQL}, a AS (SELECT * FROM r WHERE version = 'v1'), b AS (SELECT * FROM r WHERE version = 'v2'),
       j AS (SELECT coalesce(a.field, b.field) AS field, a.type AS type_before, b.type AS type_now, coalesce(a.n, b.n) AS n FROM a FULL JOIN b ON a.field = b.field),
       p AS (SELECT g.field, h.field AS new_field, g.type_before, h.type_now, (SELECT count(DISTINCT x.value) FROM f x JOIN f y ON x.value = y.value
         WHERE x.version = 'v1' AND y.version = 'v2' AND x.field = g.field AND y.field = h.field) / least(g.n, h.n)::DOUBLE AS overlap
         FROM j g, j h WHERE g.type_now IS NULL AND h.type_before IS NULL AND g.type_before = h.type_now AND least(g.n, h.n) >= 3),
       m AS (SELECT * FROM p WHERE overlap >= 0.5)
       SELECT 'v2' AS version, 'v1' AS previous, 'renamed' AS change, field, new_field, type_before, type_now, overlap FROM m
       UNION ALL SELECT 'v2', 'v1', CASE WHEN type_before IS NULL THEN 'added' WHEN type_now IS NULL THEN 'removed' ELSE 'retyped' END, field, NULL,
       type_before, type_now, NULL FROM j WHERE type_before IS DISTINCT FROM type_now
       AND field NOT IN (SELECT field FROM m) AND field NOT IN (SELECT new_field FROM m)""")
def schema_drift_rows(spark, d):
    return schema_rows.version_drift(_versions(spark, d))


@query("string_fields_rows", f"WITH {_VERSIONS_SQL} SELECT version, field FROM r WHERE type = 'string'")
def string_fields_rows(spark, d):
    return schema_rows.string_fields(_versions(spark, d))
