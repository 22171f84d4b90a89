"""Queries for the scalar functions and the cleaning projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from claravoz.catalog import survey as sv
from claravoz.catalog.registry import query, table
from claravoz.catalog.survey import SURVEY_SQL, survey
from claravoz.functions import dates, scoring, text, vectors
from claravoz.functions.sql import register
from claravoz.operators import feedback, schema

# Documents with blanks or a formula prefix added by rule, since the raw table has none.
_DIRTY = (
    "CASE WHEN doc_id % 7 = 0 THEN chr(8195) || text || chr(9) WHEN doc_id % 11 = 0 THEN '=' || text"
    " WHEN doc_id % 13 = 0 THEN '  @cmd ' || text ELSE text END"
)


def _dirty(spark, d):
    key = F.col("doc_id")
    value = (
        F.when(key % 7 == 0, F.concat(F.lit(" "), "text", F.lit("\t")))
        .when(key % 11 == 0, F.concat(F.lit("="), "text"))
        .when(key % 13 == 0, F.concat(F.lit("  @cmd "), "text")).otherwise(F.col("text"))
    )
    return table(spark, d, "documents", spread=True).select("doc_id", value.alias("x"))


_DIRTY_SQL = f"WITH dirty AS (SELECT doc_id, {_DIRTY} AS x FROM documents)"


@query("unicode_strip", f"{_DIRTY_SQL} SELECT doc_id, {sv.strip_sql('x')} AS y, "
       f"x <> {sv.strip_sql('x')} AS padded FROM dirty")
def unicode_strip(spark, d):
    return _dirty(spark, d).select(
        "doc_id", text.strip(F.col("x")).alias("y"), text.is_padded(F.col("x")).alias("padded"))


@query("null_to_blank_text", f"""WITH t AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN {_DIRTY} END AS x
       FROM documents d LEFT JOIN labels l USING (doc_id))
       SELECT doc_id, coalesce({sv.strip_sql('x')}, '') AS y FROM t""")
def null_to_blank_text(spark, d):
    labelled = table(spark, d, "labels").select("doc_id", F.lit(True).alias("known"))
    value = F.when(F.col("known").isNull(), F.col("x"))
    return _dirty(spark, d).join(labelled, "doc_id", "left").select(
        "doc_id", text.strip_or_blank(value).alias("y"))


@query("boolean_normalize", f"""SELECT event_id, {sv.boolean_sql(sv.written_flag_sql('event_id'))} AS flag,
       value <> 0 AS from_number FROM events""")
def boolean_normalize(spark, d):
    events = table(spark, d, "events")
    return events.select(
        "event_id", text.normalize_boolean(sv.written_flag(F.col("event_id"))).alias("flag"),
        text.normalize_boolean(F.col("value"), events.schema["value"].dataType).alias("from_number"))


@query("boolean_two_valued",
       f"SELECT event_id, {sv.two_valued_sql(sv.written_flag_sql('event_id'))} AS flag FROM events")
def boolean_two_valued(spark, d):
    return table(spark, d, "events").select(
        "event_id", text.two_valued_boolean(sv.written_flag(F.col("event_id"))).alias("flag"))


def _date_text(f):
    return f"strftime({sv.date_sql(sv.written_date_sql('o_orderdate', 'o_orderkey'), f)}, '%Y-%m-%d')"


@query("date_flexible", f"SELECT o_orderkey, {_date_text(dates.GENERAL_FORMATS)} AS iso FROM orders")
def date_flexible(spark, d):
    written = sv.written_date(F.col("o_orderdate"), F.col("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", dates.iso_date(written).alias("iso"))


@query("date_survey_formats", f"SELECT o_orderkey, {_date_text(dates.SURVEY_FORMATS)} AS iso FROM orders")
def date_survey_formats(spark, d):
    written = sv.written_date(F.col("o_orderdate"), F.col("o_orderkey"))
    return table(spark, d, "orders").select(
        "o_orderkey", dates.iso_date(written, dates.SURVEY_FORMATS).alias("iso"))


@query("html_escape", f"SELECT page_id, {sv.escape_sql('html')} AS y FROM pages")
def html_escape(spark, d):
    return table(spark, d, "pages", spread=True).select("page_id", text.html_escape(F.col("html")).alias("y"))


@query("tag_strip", "SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS y FROM pages")
def tag_strip(spark, d):
    return table(spark, d, "pages", spread=True).select("page_id", text.strip_tags(F.col("html")).alias("y"))


@query("injection_pattern_removal", f"SELECT page_id, {sv.patterns_sql('html')} AS y FROM pages")
def injection_pattern_removal(spark, d):
    return table(spark, d, "pages", spread=True).select("page_id", text.drop_injection_patterns(F.col("html")).alias("y"))


@query("sanitize_pages", f"SELECT page_id, {sv.markup_sql('html')} AS y FROM pages")
def sanitize_pages(spark, d):
    return table(spark, d, "pages", spread=True).select("page_id", text.sanitize_markup(F.col("html")).alias("y"))


@query("sanitize_keep_unicode", f"SELECT doc_id, {sv.markup_sql('text', True)} AS y FROM documents")
def sanitize_keep_unicode(spark, d):
    return table(spark, d, "documents", spread=True).select(
        "doc_id", text.sanitize_markup(F.col("text"), "keep_unicode").alias("y"))


@query("formula_escape", f"{_DIRTY_SQL} SELECT doc_id, {sv.formula_sql('x')} AS y FROM dirty")
def formula_escape(spark, d):
    return _dirty(spark, d).select("doc_id", text.escape_formula(F.col("x")).alias("y"))


@query("sanitize_text", f"""{_DIRTY_SQL} SELECT doc_id, {sv.formula_sql('m')} AS y
       FROM (SELECT doc_id, {sv.markup_sql('x')} AS m FROM dirty)""")
def sanitize_text(spark, d):
    return _dirty(spark, d).select("doc_id", text.sanitize_text(F.col("x"), excel_safe=True).alias("y"))


@query("comment_sanitizer", f"""WITH {SURVEY_SQL} SELECT answer_id, {sv.strip_sql(
    "regexp_replace(regexp_replace(comentario, '<script.*?>.*?</script>', '', 'gi'),"
    " '^=@[A-Z]+[(].*?[)][[:space:]]*', '')")} AS y FROM survey""")
def comment_sanitizer(spark, d):
    return survey(spark, d).select("answer_id", text.clean_comment(F.col("comentario")).alias("y"))


@query("comment_guard", f"""WITH {SURVEY_SQL}, g AS (SELECT answer_id, regexp_replace(regexp_replace(
       regexp_replace(regexp_replace(regexp_replace(comentario, '<script[^>]*>.*?</script>', '', 'gi'),
       '<iframe[^>]*>.*?</iframe>', '', 'gi'), 'javascript:', '', 'gi'), 'onerror=', '', 'gi'),
       'onload=', '', 'gi') AS x FROM survey)
       SELECT answer_id, {sv.strip_sql("CASE WHEN substr(x, 1, 1) IN ('=','@','+','-') THEN '''' || x ELSE x END")}
       AS y FROM g""")
def comment_guard(spark, d):
    return survey(spark, d).select("answer_id", text.guard_comment(F.col("comentario")).alias("y"))


@query("dangerous_formula_flag", f"""{_DIRTY_SQL} SELECT doc_id, substr({sv.strip_sql('x')}, 1, 1)
       IN ('=','+','-','@') AND regexp_matches(x, 'cmd|system|exec|dde|hyperlink|importdata|webservice', 'i')
       AS dangerous FROM dirty""")
def dangerous_formula_flag(spark, d):
    return _dirty(spark, d).select("doc_id", text.has_dangerous_formula(F.col("x")).alias("dangerous"))


_CLASS_SQL = {
    "script": "regexp_matches({x}, '<script[^>]*>', 'is')",
    "event_handler": r"regexp_matches({x}, 'on[\p{{L}}\p{{N}}_]+\s*=', 'i')",
    "protocol": "regexp_matches({x}, 'javascript:|vbscript:|data:text/html', 'i')",
    "frame": "regexp_matches({x}, '<(iframe|embed|object)[^>]*>', 'is')",
    "svg": r"regexp_matches({x}, '<svg[^>]*on[\p{{L}}\p{{N}}_]+', 'is')",
    "entity": "regexp_matches({x}, '&#([0-9]+|x[0-9a-f]+);', 'i')",
    "formula": r"regexp_matches({x}, '^\s*[=+@-]')",
}


def _classes_sql(x):
    arms = ", ".join(f"CASE WHEN {test.format(x=x)} THEN '{name}' END" for name, test in _CLASS_SQL.items())
    return f"concat_ws(',', {arms})"


@query("attack_class_labels", f"SELECT page_id, {_classes_sql('html')} AS attacks FROM pages")
def attack_class_labels(spark, d):
    return table(spark, d, "pages", spread=True).select(
        "page_id", F.array_join(text.attack_classes(F.col("html")), ",").alias("attacks"))


_FOLDED = "translate(lower(comentario), 'áéíóúüñ', 'aeiouun')"


@query("pain_point_extraction", f"""WITH {SURVEY_SQL} SELECT answer_id, coalesce(pain_points,
       {"CASE " + " ".join(f"WHEN contains({_FOLDED}, '{k}') THEN '{n}'" for n, k in text.PAIN_POINT_KEYWORDS.items())
        + " END"}, 'unspecified') AS pain_point FROM survey""")
def pain_point_extraction(spark, d):
    return survey(spark, d).select(
        "answer_id", text.fill_pain_point(F.col("pain_points"), F.col("comentario")).alias("pain_point"))


@query("json_encode_decode", """SELECT c_custkey, c_name, c_acctbal, CAST(json_object('c_custkey', c_custkey,
       'c_name', c_name) AS VARCHAR) AS payload FROM customer""")
def json_encode_decode(spark, d):
    packed = table(spark, d, "customer").select(
        F.to_json(F.struct("c_custkey", "c_name")).alias("payload"),
        F.to_json(F.struct("*")).alias("full"))
    fields = F.from_json("full", "c_custkey long, c_name string, c_acctbal double")
    return packed.select(fields.alias("f"), "payload").select("f.*", "payload")


_LOGITS = "[c_acctbal / 1000, c_nationkey / 5.0, length(c_mktsegment) / 3.0, 1.0, c_custkey % 5]"


@query("softmax_and_labels", f"""WITH t AS (SELECT c_custkey, list_transform({_LOGITS}, lambda x: CAST(x AS DOUBLE)) AS l
       FROM customer), e AS (SELECT c_custkey, list_transform(l, lambda x: exp(x - list_max(l))) AS p FROM t),
       s AS (SELECT c_custkey, list_transform(p, lambda x: x / list_sum(p)) AS q FROM e)
       SELECT c_custkey, round(q[1], 9) AS first, round(q[5], 9) AS last,
       CASE WHEN q[2] > q[1] THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sentiment,
       round(greatest(q[1], q[2]), 9) AS confidence,
       ['Very Negative', 'Negative', 'Neutral', 'Positive', 'Very Positive'][list_position(q, list_max(q))]
       AS label FROM s""")
def softmax_and_labels(spark, d):
    logits = F.array(*(c.cast("double") for c in (
        F.col("c_acctbal") / 1000, F.col("c_nationkey") / 5.0, F.length("c_mktsegment") / 3.0, F.lit(1.0),
        F.col("c_custkey") % 5)))
    p = table(spark, d, "customer").select("c_custkey", scoring.softmax(logits).alias("q"))
    first, second = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    return p.select(
        "c_custkey", F.round(first, 9).alias("first"), F.round(F.get("q", F.lit(4)), 9).alias("last"),
        scoring.sentiment(second, first).alias("sentiment"),
        F.round(scoring.confidence(second, first), 9).alias("confidence"),
        scoring.five_class_label(F.col("q")).alias("label"))


@query("vector_unit_length", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)
       * (label + 1)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x)))
       AS n FROM e) SELECT vec_id, round(n, 6) AS norm, round(v[1] / n, 6) AS head,
       round(v[64] / n, 6) AS tail FROM n""")
def vector_unit_length(spark, d):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    v = table(spark, d, "embeddings").select("vec_id", scaled.alias("v"))
    unit = v.select("vec_id", F.round(vectors.norm(F.col("v")), 6).alias("norm"), vectors.unit(F.col("v")).alias("u"))
    return unit.select("vec_id", "norm", F.round(F.get("u", F.lit(0)), 6).alias("head"),
                       F.round(F.get("u", F.lit(63)), 6).alias("tail"))


@query("percent_helpers", f"""SELECT o_orderpriority, count(*) AS n,
       {sv.percent_sql("count(*) FILTER (o_orderstatus = 'F')", 'count(*)')} AS pct,
       {sv.ratio_sql("count(*) FILTER (o_orderstatus = 'F')", 'count(*)')} AS ratio
       FROM orders GROUP BY o_orderpriority""")
def percent_helpers(spark, d):
    done = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), done.alias("done")
    ).select("o_orderpriority", "n", scoring.percent(F.col("done"), F.col("n")).alias("pct"),
             scoring.ratio(F.col("done"), F.col("n")).alias("ratio"))


@query("version_stamp", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS version FROM events")
def version_stamp(spark, d):
    return table(spark, d, "events").select("event_id", dates.version_stamp(F.col("ts")).alias("version"))


@query("sql_functions", f"""SELECT o_orderkey, {sv.boolean_sql(sv.written_flag_sql('o_orderkey'))} AS flag,
       {_date_text(dates.GENERAL_FORMATS)} AS iso FROM orders""")
def sql_functions(spark, d):
    register(spark)
    key = F.col("o_orderkey")
    written = table(spark, d, "orders").select(
        "o_orderkey", sv.written_flag(key).alias("f"), sv.written_date(F.col("o_orderdate"), key).alias("w"))
    return spark.sql(
        "SELECT o_orderkey, clean_boolean(f) AS flag, date_format(clean_date(w), 'yyyy-MM-dd') AS iso FROM {w}",
        w=written)


# --- projections ------------------------------------------------------------------------


@query("survey_fixed_clean", f"""WITH {SURVEY_SQL} SELECT answer_id, {sv.strip_sql('plan')} AS plan,
       {sv.formula_sql(sv.markup_sql(sv.strip_sql('comentario')))} AS comentario,
       {sv.boolean_sql('outage_flag')} AS outage_flag,
       strftime({sv.date_sql('fecha', dates.GENERAL_FORMATS)}, '%Y-%m-%d') AS fecha FROM survey""")
def survey_fixed_clean(spark, d):
    return schema.clean_survey(survey(spark, d)).select(
        "answer_id", "plan", "comentario", "outage_flag", "fecha")


PREPROCESSED_SQL = f"""clean AS (SELECT answer_id, coalesce({sv.strip_sql('plan')}, '') AS plan,
    coalesce({sv.strip_sql('"NPS_GRUPO"')}, '') AS "NPS_GRUPO", coalesce({sv.strip_sql('churn_risk')}, '') AS churn_risk,
    coalesce({sv.strip_sql('region')}, '') AS region, coalesce({sv.strip_sql('dispositivo')}, '') AS dispositivo,
    {sv.two_valued_sql('outage_flag')} AS outage_flag, {sv.two_valued_sql('fcr')} AS fcr,
    {sv.strip_sql("regexp_replace(regexp_replace(comentario, '<script.*?>.*?</script>', '', 'gi'),"
                  " '^=@[A-Z]+[(].*?[)][[:space:]]*', '')")} AS comentario,
    strftime({sv.date_sql('fecha', dates.SURVEY_FORMATS)}, '%Y-%m-%d') AS fecha_parsed,
    coalesce(pain_points, CASE WHEN contains(lower(comentario), 'router') THEN 'Router' END, 'unspecified')
      AS pain_points, agent_id, "NOTA", dia FROM survey)"""


@query("survey_documented_clean", f"WITH {SURVEY_SQL}, {PREPROCESSED_SQL} SELECT * EXCLUDE (agent_id, \"NOTA\", dia) FROM clean")
def survey_documented_clean(spark, d):
    return feedback.preprocess_survey(survey(spark, d)).select(
        "answer_id", "plan", "NPS_GRUPO", "churn_risk", "region", "dispositivo", "outage_flag", "fcr",
        "comentario", F.date_format("fecha_parsed", "yyyy-MM-dd").alias("fecha_parsed"), "pain_points")


_TEXTS = ("fecha", "region", "plan", "NPS_GRUPO", "comentario", "pain_points", "outage_flag", "fcr")


def _detected_sql(c):
    filled = f'count("{c}")'
    return (
        f"SELECT '{c}' AS \"column\", CASE WHEN count({sv.boolean_sql(f'{chr(34)}{c}{chr(34)}')}) > 0.8 * {filled}"
        f" THEN 'boolean' WHEN count({sv.date_sql(f'{chr(34)}{c}{chr(34)}', dates.GENERAL_FORMATS)}) > 0.8 * {filled}"
        f" THEN 'date' ELSE 'string' END AS type FROM survey"
    )


@query("type_detection", f"WITH {SURVEY_SQL} " + " UNION ALL ".join(_detected_sql(c) for c in _TEXTS)
       + " UNION ALL SELECT 'NOTA', 'integer' UNION ALL SELECT 'dia', 'date' UNION ALL SELECT 'answer_id', 'integer'")
def type_detection(spark, d):
    return schema.detect_schema(survey(spark, d).select("answer_id", "dia", "NOTA", *_TEXTS))


@query("auto_clean", f"""WITH {SURVEY_SQL} SELECT answer_id, "NOTA", {sv.boolean_sql('outage_flag')} AS outage_flag,
       {sv.boolean_sql('fcr')} AS fcr,
       strftime({sv.date_sql('fecha', dates.GENERAL_FORMATS)}, '%Y-%m-%d') AS fecha,
       {sv.formula_sql(sv.markup_sql(sv.strip_sql('comentario')))} AS comentario,
       {sv.formula_sql(sv.markup_sql(sv.strip_sql('region')))} AS region FROM survey""")
def auto_clean(spark, d):
    raw = survey(spark, d).select("answer_id", "NOTA", "outage_flag", "fcr", "fecha", "comentario", "region")
    # one row per column
    types = {r["column"]: r["type"] for r in schema.detect_schema(raw).collect()}
    return schema.clean(raw, types)


@query("attack_filter", f"""WITH c AS (SELECT {sv.markup_sql('html')} AS h, {sv.markup_sql('url')} AS u FROM pages)
       SELECT 'html' AS "column", count(*) FILTER (regexp_matches(h, '&lt;script|&lt;iframe|&#')) AS blocked FROM c
       UNION ALL SELECT 'url', count(*) FILTER (regexp_matches(u, '&lt;script|&lt;iframe|&#')) FROM c""")
def attack_filter(spark, d):
    pages = table(spark, d, "pages", spread=True)
    clean = pages.select(*(text.sanitize_markup(F.col(c)).alias(c) for c in ("html", "url")))
    return schema.blocked_attacks(clean)


_MAPPED_SQL = """mapped AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN ' ' ELSE CAST(user_id AS VARCHAR) END
    AS user_id, CASE WHEN event_id % 8 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS "timestamp",
    CASE WHEN event_id % 10 = 0 THEN 'x' WHEN event_id % 10 = 1 THEN NULL
    ELSE CAST(event_id % 13 AS VARCHAR) END AS nps FROM events)"""
_VIOLATIONS = """CASE WHEN trim(user_id) = '' THEN 'user_id empty' END, CASE WHEN "timestamp" = 'bad' THEN
    'timestamp unreadable' END, CASE WHEN nps IS NOT NULL AND (TRY_CAST(nps AS INTEGER) IS NULL
    OR TRY_CAST(nps AS INTEGER) NOT BETWEEN 0 AND 10) THEN 'nps out of range' END"""


def _mapped(spark, d):
    key = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", F.when(key % 9 == 0, " ").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(key % 8 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        F.when(key % 10 == 0, "x").when(key % 10 == 1, F.lit(None))
        .otherwise((key % 13).cast("string")).alias("nps"))


@query("curated_accept", f"""WITH {_MAPPED_SQL} SELECT event_id, user_id, "timestamp", CAST(nps AS INTEGER) AS nps
       FROM mapped WHERE concat_ws(',', {_VIOLATIONS}) = ''""")
def curated_accept(spark, d):
    accepted, _ = schema.curate(_mapped(spark, d))
    return accepted.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@query("curated_reject", f"""WITH {_MAPPED_SQL}, v AS (SELECT event_id, concat_ws(',', {_VIOLATIONS}) AS violations
       FROM mapped) SELECT * FROM v WHERE violations <> ''""")
def curated_reject(spark, d):
    _, rejected = schema.curate(_mapped(spark, d))
    return rejected.select("event_id", F.array_join("violations", ",").alias("violations"))
