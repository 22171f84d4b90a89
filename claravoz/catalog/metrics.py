"""Queries for data-quality metrics, audit, survey analytics and telemetry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claravoz.catalog import survey as sv
from claravoz.catalog.cleaning import PREPROCESSED_SQL, _classes_sql
from claravoz.catalog.registry import query, table
from claravoz.catalog.survey import SURVEY_SQL, survey
from claravoz.functions import dates, scoring, text
from claravoz.operators import cardinality, feedback, frequent, quality, schema, telemetry
from claravoz.sources.readers import spread_small

_FIELDS = ("plan", "region", "NPS_GRUPO", "comentario", "pain_points", "fcr")


def _dirty_survey(spark, d):
    return survey(spark, d).select(*_FIELDS, "NOTA")


_DIRTY_SURVEY_SQL = f"WITH {SURVEY_SQL}, s AS (SELECT " + ", ".join(f'"{c}"' for c in (*_FIELDS, "NOTA")) + " FROM survey)"


def _report_sql(phase, source, columns, texts, width):
    """Long quality report of ``source``, metric by metric."""
    q = {c: f'"{c}"' for c in columns}
    n = f"(SELECT count(*) FROM {source})"
    nulls = "(" + " + ".join(f"(SELECT count(*) FROM {source} WHERE {q[c]} IS NULL)" for c in columns) + ")"
    pads = {c: f"(SELECT count(*) FROM {source} WHERE {q[c]} <> {sv.strip_sql(q[c])})" for c in texts}
    padded = "(" + " + ".join(pads.values()) + ")"
    dup = f"({n} - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})))"
    rows = [
        ("NULL", "total_records", n), ("NULL", "total_cells", f"({n} * {width})"), ("NULL", "total_nulls", nulls),
        ("NULL", "null_percentage", sv.percent_sql(nulls, f"({n} * {width})")),
        ("NULL", "whitespace_contamination", padded), ("NULL", "whitespace_percentage", sv.percent_sql(padded, n)),
        ("NULL", "duplicate_rows", dup), ("NULL", "duplicate_percentage", sv.percent_sql(dup, n)),
    ]
    for c in columns:
        one = f"(SELECT count(*) FROM {source} WHERE {q[c]} IS NULL)"
        rows += [(f"'{c}'", "null_count", one), (f"'{c}'", "null_percentage", sv.percent_sql(one, n))]
    for c in texts:
        rows += [(f"'{c}'", "whitespace_count", pads[c]), (f"'{c}'", "whitespace_percentage", sv.percent_sql(pads[c], n))]
    return " UNION ALL ".join(
        f"SELECT '{phase}' AS phase, CAST({c} AS VARCHAR) AS \"column\", '{m}' AS metric, CAST({v} AS DOUBLE) AS value"
        for c, m, v in rows
    )


@query("quality_report", f"{_DIRTY_SURVEY_SQL} " + _report_sql("data", "s", (*_FIELDS, "NOTA"), _FIELDS, 7))
def quality_report(spark, d):
    return quality.quality_report(_dirty_survey(spark, d))


_CLEANED_SQL = f"""c AS (SELECT {sv.formula_sql(sv.markup_sql(sv.strip_sql('plan')))} AS plan,
    {sv.formula_sql(sv.markup_sql(sv.strip_sql('region')))} AS region,
    {sv.formula_sql(sv.markup_sql(sv.strip_sql('"NPS_GRUPO"')))} AS "NPS_GRUPO",
    {sv.formula_sql(sv.markup_sql(sv.strip_sql('comentario')))} AS comentario,
    {sv.formula_sql(sv.markup_sql(sv.strip_sql('pain_points')))} AS pain_points,
    {sv.boolean_sql('fcr')} AS fcr, "NOTA" FROM s)"""
_IMPROVED_SQL = """SELECT * FROM r UNION ALL SELECT 'improvements', NULL, 'null_values_reduced',
    sum(CASE WHEN phase = 'before' THEN value ELSE -value END) FROM r WHERE metric = 'total_nulls' UNION ALL
    SELECT 'improvements', NULL, 'whitespace_cleaned', sum(CASE WHEN phase = 'before' THEN value ELSE -value END)
    FROM r WHERE metric = 'whitespace_contamination'"""


@query("quality_before_after", f"{_DIRTY_SURVEY_SQL}, {_CLEANED_SQL}, r AS ("
       + _report_sql("before", "s", (*_FIELDS, "NOTA"), _FIELDS, 7) + " UNION ALL "
       + _report_sql("after", "c", (*_FIELDS, "NOTA"), _FIELDS[:-1], 7) + f") {_IMPROVED_SQL}")
def quality_before_after(spark, d):
    raw = _dirty_survey(spark, d)
    return quality.before_after_report(raw, schema.cleaning_columns(raw, {"fcr": "boolean"}))


@query("quality_issues", f"{_DIRTY_SURVEY_SQL} " + " UNION ALL ".join(
    f"SELECT 'null_values' AS issue, '{c}' AS \"column\", "
    + sv.ratio_sql(f'count(*) FILTER ("{c}" IS NULL)', "count(*)") + " AS value FROM s"
    for c in (*_FIELDS, "NOTA")) + " UNION ALL SELECT 'whitespace_contamination', NULL, ("
    + " + ".join(f'count(*) FILTER ("{c}" <> {sv.strip_sql(chr(34) + c + chr(34))})' for c in _FIELDS)
    + ")::DOUBLE / count(*) FROM s UNION ALL SELECT 'total_records', NULL, count(*)::DOUBLE FROM s UNION ALL "
    "SELECT 'duplicate_rows', NULL, ((SELECT count(*) FROM s) - (SELECT count(*) FROM (SELECT DISTINCT * FROM s)))::DOUBLE")
def quality_issues(spark, d):
    return quality.quality_issues(_dirty_survey(spark, d))


@query("whitespace_by_field", f"{_DIRTY_SURVEY_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (\"{c}\" <> {sv.strip_sql(chr(34) + c + chr(34))}) AS affected,"
    f" {sv.percent_sql(f'count(*) FILTER ({chr(34)}{c}{chr(34)} <> {sv.strip_sql(chr(34) + c + chr(34))})', 'count(*)')}"
    f" AS pct FROM s" for c in _FIELDS))
def whitespace_by_field(spark, d):
    report = quality.quality_report(_dirty_survey(spark, d), duplicates=False).where(F.col("column").isNotNull())
    return report.groupBy("column").agg(
        F.max(F.when(F.col("metric") == "whitespace_count", F.col("value"))).cast("long").alias("affected"),
        F.max(F.when(F.col("metric") == "whitespace_percentage", F.col("value"))).alias("pct"),
    ).where(F.col("affected").isNotNull())


@query("duplicate_documents", f"""SELECT count(*) AS n, count(*) - count(DISTINCT (text, lang)) AS duplicate_rows,
       {sv.percent_sql('(count(*) - count(DISTINCT (text, lang)))', 'count(*)')} AS duplicate_pct FROM documents""")
def duplicate_documents(spark, d):
    report = quality.quality_report(table(spark, d, "documents").select("text", "lang"))

    def value(metric):
        wanted = F.col("column").isNull() & (F.col("metric") == metric)
        return F.max(F.when(wanted, F.col("value")))

    return report.agg(
        value("total_records").cast("long").alias("n"), value("duplicate_rows").cast("long").alias("duplicate_rows"),
        value("duplicate_percentage").alias("duplicate_pct"))


@query("distinct_documents", "SELECT DISTINCT text, lang FROM documents")
def distinct_documents(spark, d):
    return table(spark, d, "documents").select("text", "lang").distinct()


def _stats_sql(source, columns, texts):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (\"{c}\" IS NULL) AS nulls, "
        + (f"count(*) FILTER (\"{c}\" = '')" if c in texts else "0")
        + f" AS empty_strings, count(DISTINCT \"{c}\") AS distincts FROM {source}" for c in columns
    )


@query("column_stats", f"{_DIRTY_SURVEY_SQL} " + _stats_sql("s", (*_FIELDS, "NOTA"), _FIELDS))
def column_stats(spark, d):
    return quality.column_stats(_dirty_survey(spark, d))


@query("column_stats_lineitem", _stats_sql("lineitem", (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"), ("l_returnflag", "l_linestatus")))
def column_stats_lineitem(spark, d):
    # a task keeps the distinct cells of its rows in memory, so its rows are bounded, too
    return quality.column_stats(spread_small(table(spark, d, "lineitem"), task_bytes=8 * 1024 * 1024))


_DESCRIBED = ("o_custkey", "o_totalprice", "o_orderstatus")


@query("describe_orders", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, {'round(avg(' + c + '), 4)' if c != 'o_orderstatus' else 'NULL'} AS mean,"
    f" {'round(stddev(' + c + '), 4)' if c != 'o_orderstatus' else 'NULL'} AS stddev,"
    f" {'CAST(min(' + c + ') AS DOUBLE)' if c != 'o_orderstatus' else 'NULL'} AS low, min({c})::VARCHAR IS NOT NULL AS known"
    " FROM orders" for c in _DESCRIBED))
def describe_orders(spark, d):
    long = quality.describe(table(spark, d, "orders").select(*_DESCRIBED))

    def metric(name):
        return F.max(F.when(F.col("metric") == name, F.col("value")))

    return long.groupBy("column").agg(
        metric("count").cast("long").alias("n"), F.round(metric("mean").cast("double"), 4).alias("mean"),
        F.round(metric("stddev").cast("double"), 4).alias("stddev"),
        F.expr("try_cast(max(if(metric = 'min', value, null)) AS double)").alias("low"),
        metric("min").isNotNull().alias("known"))


_DIGEST = "sha256(to_json({'doc_id': doc_id, 'text': text, 'lang': lang, 'source': source, 'n_chars': n_chars}))"


@query("content_hash", f"""SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr({_DIGEST}, 1, 15)) AS HUGEINT))
       AS VARCHAR) AS content_hash FROM documents""")
def content_hash(spark, d):
    return quality.content_hash(table(spark, d, "documents"))


_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
_CUSTOMER_DIGEST = "sha256(to_json({" + ", ".join(f"'{c}': {c}" for c in _CUSTOMER) + "}))"


def _listed_sql(value):
    """SQL of name=value of all columns, in order of names."""
    return " || '|' || ".join(f"'{c}=' || {value.format(c=c)}" for c in sorted(_CUSTOMER))


@query("audit_record", f"""WITH c AS (SELECT c_custkey, nullif(c_name, 'Customer#000000007') AS c_name, c_nationkey,
           c_acctbal, if(c_mktsegment = 'BUILDING', '', c_mktsegment) AS c_mktsegment FROM customer)
       SELECT 'v1' AS schema_version, count(*) AS rows, 5 AS "columns",
       'passed' AS status, count(*) - count(c_name) AS null_names, 'INFO: 2 columns not mapped to canonical schema' AS alerts,
       {_listed_sql("(count(*) - count({c}))")} AS nulls,
       {_listed_sql("count(*) FILTER (CAST({c} AS VARCHAR) = '')")} AS empty_strings,
       {_listed_sql("count(DISTINCT {c})")} AS distincts,
       CAST(sum(CAST(('0x' || substr({_CUSTOMER_DIGEST}, 1, 15)) AS HUGEINT)) AS VARCHAR) AS content_hash FROM c""")
def audit_record(spark, d):
    customer = table(spark, d, "customer").select(
        "c_custkey", F.nullif("c_name", F.lit("Customer#000000007")).alias("c_name"), "c_nationkey", "c_acctbal",
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    audit = quality.audit_record(customer, "v1", "customer", "out", 2, 3)

    def listed(name):
        return F.array_join(F.transform(F.map_entries(name), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias(name)

    return quality.validate_audit(audit).select(
        "schema_version", "rows", "columns", "status", F.col("nulls")["c_name"].alias("null_names"),
        F.array_join("alerts", "|").alias("alerts"), listed("nulls"), listed("empty_strings"), listed("distincts"), "content_hash")


def _order_audits(spark, d):
    """Audits of the orders of each year, with sketches; statuses of later years are blanked."""
    orders = table(spark, d, "orders").select(
        F.year("o_orderdate").alias("year"), F.when(F.year("o_orderdate") < 1999, F.col("o_orderstatus")).alias("status"),
        F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    audits = [quality.audit_record(orders.where(F.col("year") == y).drop("year"), str(y), "orders", "out", sketch_bits=12)
              for y in range(1995, 2002)]
    return cardinality.column_history(reduce(DataFrame.unionByName, audits))


_YEARS_SQL = """WITH o AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS version,
        CASE WHEN year(o_orderdate) < 1999 THEN o_orderstatus END AS status, o_orderpriority AS priority,
        strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2001),
    cells AS (FROM o UNPIVOT INCLUDE NULLS (v FOR "column" IN (status, priority, month))),
    counted AS (SELECT version, "column", count(*) AS rows, count(*) - count(v) AS nulls, list(DISTINCT v) FILTER (v IS NOT NULL) AS vals
        FROM cells GROUP BY ALL)"""


@query("total_cardinality", _YEARS_SQL + """ SELECT "column", count(DISTINCT version) AS versions, count(*) AS rows,
    count(DISTINCT v) AS distincts FROM cells GROUP BY "column\"""")
def total_cardinality(spark, d):
    return cardinality.total_cardinality(_order_audits(spark, d))


@query("cardinality_drift", _YEARS_SQL + """, sets AS (SELECT *, coalesce(vals, []) AS s FROM counted),
    pairs AS (SELECT *, lag(version) OVER w AS previous, lag(s) OVER w AS t, lag(nulls / rows) OVER w AS null_share_before
        FROM sets WINDOW w AS (PARTITION BY "column" ORDER BY version)),
    diffs AS (SELECT version, previous, "column", len(s) AS distincts, len(t) AS distincts_before,
        len(list_filter(s, lambda x: NOT list_contains(t, x))) AS gained, len(list_filter(t, lambda x: NOT list_contains(s, x))) AS lost,
        nulls / rows AS null_share, null_share_before FROM pairs WHERE previous IS NOT NULL)
    SELECT *, concat_ws(',', CASE WHEN distincts_before - distincts > 0.5 * distincts_before THEN 'collapsed' END,
        CASE WHEN distincts - distincts_before > 0.5 * distincts_before THEN 'grown' END,
        CASE WHEN lost > 0.5 * distincts_before THEN 'replaced' END,
        CASE WHEN abs(null_share - null_share_before) > 0.5 THEN 'null_share' END) AS alerts FROM diffs""")
def cardinality_drift(spark, d):
    return cardinality.cardinality_drift(_order_audits(spark, d)).withColumn("alerts", F.array_join("alerts", ","))


_AUDITS_SQL = """a AS (SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS rows,
    count(*) FILTER (o_totalprice > 250000) * 2 AS nulls, max(o_orderkey % 4) AS unmapped FROM orders GROUP BY o_custkey)"""


@query("audit_validation", f"""WITH {_AUDITS_SQL}, p AS (SELECT *, CASE WHEN rows > 0 THEN nulls / (rows * 3) * 100
       ELSE 0.0 END AS share FROM a) SELECT o_custkey, CASE WHEN share > 50 THEN 'warning' WHEN rows = 0 THEN 'failed'
       ELSE 'passed' END AS status, round(share, 6) AS null_percentage,
       CAST((rows = 0)::INT + (share > 50)::INT + (unmapped > 0)::INT AS INTEGER) AS n_alerts FROM p""")
def audit_validation(spark, d):
    audits = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") != "P").alias("rows"),
        (F.count_if(F.col("o_totalprice") > 250000) * 2).alias("n"),
        F.max(F.col("o_orderkey") % 4).alias("unmapped_count"),
    ).select("o_custkey", "rows", F.lit(3).alias("columns"), F.create_map(F.lit("x"), "n").alias("nulls"),
             "unmapped_count")
    return quality.validate_audit(audits).select(
        "o_custkey", "status", F.round("null_percentage", 6).alias("null_percentage"),
        F.size("alerts").alias("n_alerts"))


_HISTORY_SQL = """h AS (SELECT o_orderpriority AS source, o_orderkey AS version, CAST(o_custkey % 500 AS VARCHAR) AS content_hash,
    o_orderstatus <> 'P' AS has_b, CASE WHEN o_totalprice > 200000 THEN 'int' ELSE 'string' END AS a_type FROM orders),
    st AS (SELECT *, lag(has_b) OVER w AS had_b, lag(a_type) OVER w AS a_before FROM h
      WINDOW w AS (PARTITION BY source ORDER BY version))"""


@query("history_guardrails", f"""WITH {_HISTORY_SQL}
       SELECT source, max(version) AS version, 'repeated_content' AS alert, content_hash AS subject, count(*) AS times
       FROM h GROUP BY source, content_hash HAVING count(*) > 1
       UNION ALL SELECT source, max(version), 'field_removed', 'b', count(*) FROM st WHERE had_b AND NOT has_b GROUP BY source
       UNION ALL SELECT source, max(version), 'type_drift', 'a', count(*) FROM st WHERE a_before <> a_type GROUP BY source""")
def history_guardrails(spark, d):
    a_type = F.when(F.col("o_totalprice") > 200000, "int").otherwise("string")
    field_a = F.struct(F.lit("a").alias("field"), a_type.alias("type"))
    field_b = F.struct(F.lit("b").alias("field"), F.lit("string").alias("type"))
    fields = F.when(F.col("o_orderstatus") != "P", F.array(field_a, field_b)).otherwise(F.array(field_a))
    return schema.history_guardrails(table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("version"),
        (F.col("o_custkey") % 500).cast("string").alias("content_hash"), fields.alias("fields")))


@query("quality_event_ratio", f"""SELECT event_type, count(*) FILTER (value > 40) AS records_affected,
       count(*) AS total_records, {sv.percent_sql('count(*) FILTER (value > 40)', 'count(*)')} AS percentage
       FROM events GROUP BY event_type""")
def quality_event_ratio(spark, d):
    counted = table(spark, d, "events").groupBy("event_type").agg(
        F.count_if(F.col("value") > 40).alias("records_affected"), F.count(F.lit(1)).alias("total_records"))
    return counted.withColumn(
        "percentage", quality.quality_event(F.col("records_affected"), F.col("total_records")))


# --- survey analytics -------------------------------------------------------------------

_SEVERITY = """count(*) AS total_comments, count(*) FILTER ("NPS_GRUPO" = 'Detractor') AS detractors,
    count(*) FILTER (churn_risk = 'Alto') AS high_churn, count(*) FILTER (churn_risk = 'Medio') AS medium_churn"""
_SCORED = """(CAST(detractors AS DOUBLE) / total_comments * 100) * 0.5::DOUBLE
    + (CAST(high_churn AS DOUBLE) / total_comments * 100) * 0.3::DOUBLE
    + (CAST(medium_churn AS DOUBLE) / total_comments * 100) * 0.2::DOUBLE"""
_LEVEL = "CASE WHEN {0} >= 40 THEN 'critical' WHEN {0} >= 30 THEN 'high' WHEN {0} >= 20 THEN 'medium' ELSE 'low' END"


def _clean(spark, d):
    return feedback.preprocess_survey(survey(spark, d))


_TOP_SQL = f"""pp AS (SELECT plan, {sv.strip_sql('pain_points')} AS pain_point, count(*) AS n FROM clean
    WHERE {sv.strip_sql('pain_points')} <> '' GROUP BY 1, 2), top AS (SELECT *, row_number() OVER (PARTITION BY plan
    ORDER BY n DESC, pain_point) AS position FROM pp)"""


@query("product_ranking", f"""WITH {SURVEY_SQL}, {PREPROCESSED_SQL}, {_TOP_SQL},
       g AS (SELECT plan, {_SEVERITY} FROM clean GROUP BY plan), sc AS (SELECT *, {_SCORED} AS score FROM g),
       t AS (SELECT plan, string_agg(pain_point || ' ' || n, '; ' ORDER BY position) AS top FROM top
         WHERE position <= 5 GROUP BY plan)
       SELECT CAST(row_number() OVER (ORDER BY score DESC, plan) AS INTEGER) AS rank, plan, total_comments, detractors,
       high_churn, medium_churn, round(score, 6) AS severity_score, {_LEVEL.format('score')} AS severity_level, top
       FROM sc LEFT JOIN t USING (plan)""")
def product_ranking(spark, d):
    ranked = feedback.rank_products(_clean(spark, d))
    top = F.array_join(F.transform("top_pain_points", lambda t: F.concat_ws(" ", t["pain_point"], t["n"])), "; ")
    return ranked.select("rank", "plan", "total_comments", "detractors", "high_churn", "medium_churn",
                         F.round("severity_score", 6).alias("severity_score"), "severity_level", top.alias("top"))


@query("product_ranking_sheet", f"""WITH {SURVEY_SQL}, {PREPROCESSED_SQL}, {_TOP_SQL},
       g AS (SELECT plan, {_SEVERITY} FROM clean GROUP BY plan), sc AS (SELECT *, {_SCORED} AS s FROM g),
       t AS (SELECT plan, string_agg(pain_point || ' (' || n || ')', ', ' ORDER BY position) AS top FROM top
         WHERE position <= 3 GROUP BY plan)
       SELECT CAST(row_number() OVER (ORDER BY s DESC, plan) AS INTEGER) AS rank, plan AS product, total_comments,
       printf('%.1f%%', CAST(detractors AS DOUBLE) / total_comments * 100) AS detractors,
       printf('%.1f%%', CAST(high_churn AS DOUBLE) / total_comments * 100) AS high_risk,
       printf('%.1f%%', CAST(medium_churn AS DOUBLE) / total_comments * 100) AS medium_risk,
       printf('%.1f', s) AS score, top AS top_problems FROM sc LEFT JOIN t USING (plan)""")
def product_ranking_sheet(spark, d):
    return feedback.ranking_sheet(feedback.rank_products(_clean(spark, d)))


@query("top_pain_points", f"""WITH {SURVEY_SQL}, {PREPROCESSED_SQL}, {_TOP_SQL}
       SELECT plan, pain_point, n, CAST(position AS INTEGER) AS position FROM top WHERE position <= 5""")
def top_pain_points(spark, d):
    return feedback.top_pain_points(_clean(spark, d))


@query("frequent_words", """WITH w AS (SELECT lang, unnest(string_split(text, ' ')) AS item FROM documents),
       c AS (SELECT lang, item, count(*) AS n FROM w WHERE item <> '' GROUP BY ALL)
       SELECT lang, item, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, item) AS INTEGER) AS position FROM c
       QUALIFY position <= 5""")
def frequent_words(spark, d):
    """The five commonest words of each language, of many rare ones."""
    words = table(spark, d, "documents", spread=True).select("lang", F.explode(F.split("text", " ")).alias("word")).where("word != ''")
    return frequent.top_items(words, "lang", F.col("word")).drop("proof")


@query("pain_point_distribution", f"""WITH {SURVEY_SQL}, {PREPROCESSED_SQL}, c AS (SELECT
       {sv.strip_sql('pain_points')} AS pain_point, count(*) AS n FROM clean GROUP BY 1)
       SELECT pain_point, n, {sv.percent_sql('n', '(SELECT sum(n) FROM c)')} AS pct FROM c""")
def pain_point_distribution(spark, d):
    return feedback.pain_point_distribution(_clean(spark, d))


_FLAGS = ("outage_flag", "fcr", "sla_cumplido", "facturacion_flag")


@query("boolean_spelling_census", f"WITH {SURVEY_SQL}, u AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS field, {c} AS spelling FROM survey" for c in _FLAGS) + f""") SELECT field, spelling,
    count(*) AS n, {sv.boolean_sql('spelling')} AS meaning FROM u GROUP BY field, spelling""")
def boolean_spelling_census(spark, d):
    return feedback.spelling_census(survey(spark, d), _FLAGS)


@query("date_format_census", f"""WITH {SURVEY_SQL} SELECT {sv.date_name_sql('fecha', dates.EXTENDED_FORMATS)} AS format,
       count(*) AS n, count({sv.date_sql('fecha', dates.EXTENDED_FORMATS)}) AS parsed FROM survey GROUP BY 1""")
def date_format_census(spark, d):
    return feedback.date_format_census(survey(spark, d), "fecha")


@query("attack_census", "WITH f AS (SELECT " + _classes_sql("html") + " AS a FROM pages) " + " UNION ALL ".join(
    f"SELECT '{c}' AS attack, count(*) FILTER (list_contains(string_split(a, ','), '{c}')) AS n, "
    + sv.percent_sql(f"count(*) FILTER (list_contains(string_split(a, ','), '{c}'))", "count(*)")
    + " AS pct FROM f" for c in text.ATTACK_CLASSES))
def attack_census(spark, d):
    return feedback.attack_census(table(spark, d, "pages", spread=True), "html")


@query("severity_score_and_level", f"""WITH g AS (SELECT o_custkey, count(*) AS total_comments,
       count(*) FILTER (o_totalprice < 200000) AS detractors, count(*) FILTER (o_orderstatus = 'P') AS high_churn,
       count(*) FILTER (o_orderstatus = 'O') AS medium_churn FROM orders GROUP BY o_custkey), s AS (
       SELECT o_custkey, {_SCORED} AS score FROM g) SELECT o_custkey, round(score, 6) AS score,
       {_LEVEL.format('score')} AS level FROM s""")
def severity_score_and_level(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") < 200000).alias("d"),
        F.count_if(F.col("o_orderstatus") == "P").alias("h"), F.count_if(F.col("o_orderstatus") == "O").alias("m"))
    score = scoring.severity_score(*(F.col(c) / F.col("n") * 100 for c in "dhm"))
    return g.select("o_custkey", F.round(score, 6).alias("score"), scoring.severity_level(score).alias("level"))


def _trend_sql(period):
    return f"""WITH {SURVEY_SQL}, {PREPROCESSED_SQL}, g AS (SELECT plan, CAST(date_trunc('{period}', dia) AS DATE)
       AS period, {_SEVERITY} FROM clean GROUP BY 1, 2), sc AS (SELECT *, {_SCORED} AS score FROM g),
       l AS (SELECT *, lag(score) OVER (PARTITION BY plan ORDER BY period) AS prev FROM sc)"""


@query("severity_trend", f"""{_trend_sql('month')} SELECT plan, strftime(period, '%Y-%m-%d') AS period,
       total_comments, round(score, 6) AS severity_score, round(prev, 6) AS previous_score,
       round(score - prev, 6) AS change, coalesce(score - prev > 0, false) AS worsening FROM l""")
def severity_trend(spark, d):
    trend = feedback.severity_trend(_clean(spark, d), "dia")
    return trend.select("plan", F.date_format("period", "yyyy-MM-dd").alias("period"), "total_comments",
                        *(F.round(c, 6).alias(c) for c in ("severity_score", "previous_score", "change")), "worsening")


@query("threshold_alerts", f"""{_trend_sql('week')} SELECT plan, strftime(period, '%Y-%m-%d') AS period,
       round(score, 6) AS severity_score, round(prev, 6) AS previous_score,
       CASE WHEN score >= 55 THEN 'raised' ELSE 'cleared' END AS alert FROM l
       WHERE (score >= 55) <> coalesce(prev >= 55, false)""")
def threshold_alerts(spark, d):
    alerts = feedback.threshold_alerts(_clean(spark, d), "dia", 55.0)
    return alerts.select("plan", F.date_format("period", "yyyy-MM-dd").alias("period"),
                         *(F.round(c, 6).alias(c) for c in ("severity_score", "previous_score")), "alert")


@query("issues_by_region", f"""WITH {SURVEY_SQL}, {PREPROCESSED_SQL}, g AS (SELECT region, {_SEVERITY},
       count(*) FILTER (pain_points <> '') AS issues FROM clean GROUP BY region), s AS (SELECT *, {_SCORED} AS score FROM g)
       SELECT region, total_comments, issues, round(score, 6) AS severity_score, {_LEVEL.format('score')} AS severity_level
       FROM s""")
def issues_by_region(spark, d):
    return feedback.issues_by_region(_clean(spark, d)).withColumn("severity_score", F.round("severity_score", 6))


@query("agent_performance", f"""WITH {SURVEY_SQL}, {PREPROCESSED_SQL} SELECT agent_id, count(*) AS contacts,
       round(avg(CAST(fcr AS INTEGER)), 6) AS resolution_rate, round(avg("NOTA"), 6) AS average_score
       FROM clean GROUP BY agent_id""")
def agent_performance(spark, d):
    return feedback.agent_performance(_clean(spark, d)).select(
        "agent_id", "contacts", F.round("resolution_rate", 6).alias("resolution_rate"),
        F.round("average_score", 6).alias("average_score"))


# --- telemetry --------------------------------------------------------------------------

BUCKET_SQL = ", ".join(
    f"count(*) FILTER (value <= {b}) AS le_{i}" for i, b in enumerate(telemetry.PROCESSING_BUCKETS))


@query("telemetry_rollup", f"""SELECT event_type, count(*) AS operations,
       CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS records, round(sum(value), 4) AS seconds,
       {BUCKET_SQL}, count(value) AS le_inf,
       round(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) / sum(value), 6) AS records_per_second
       FROM events GROUP BY event_type""")
def telemetry_rollup(spark, d):
    log = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    rolled = telemetry.processing_rollup(log, ["event_type"], "value", "k")
    return rolled.withColumns({"seconds": F.round("seconds", 4),
                               "records_per_second": F.round("records_per_second", 6)})


@query("event_counters", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id")
def event_counters(spark, d):
    return telemetry.event_counts(table(spark, d, "events"), ["event_type", "user_id"])


@query("deterministic_sample", "SELECT doc_id FROM documents WHERE CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)),"
       " 1, 8)) AS BIGINT) / 4294967296 < 0.25")
def deterministic_sample(spark, d):
    return quality.sample_rows(table(spark, d, "documents").select("doc_id"), 0.25, F.col("doc_id").cast("string"))


