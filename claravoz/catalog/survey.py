"""A survey-like view of the given tables, with dirt added by rule; and the same view in SQL.

Every order is one answer: its priority stands for the plan, its price for
the score, its status for churn risk, the customer's segment for the pain
point. Padding, mixed date formats, boolean spellings, script tags and
formulas follow from the order key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claravoz.catalog.registry import table

# The written forms of dates and flags used in the view.
DATE_FORMS = (
    ("yyyy-MM-dd", "%Y-%m-%d"), ("yyyy/MM/dd", "%Y/%m/%d"), ("dd/MM/yyyy", "%d/%m/%Y"),
    ("MM/dd/yyyy", "%m/%d/%Y"), ("dd-MM-yyyy", "%d-%m-%Y"), ("MM-dd-yyyy", "%m-%d-%Y"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), ("dd/MM/yyyy HH:mm:ss", "%d/%m/%Y %H:%M:%S"),
    ("MM/dd/yyyy HH:mm:ss", "%m/%d/%Y %H:%M:%S"), ("yy-MM-dd", "%y-%m-%d"),
    ("dd/MM/yy", "%d/%m/%y"), ("dd.MM.yyyy", "%d.%m.%Y"),
)
SPELLINGS = ("False", "True", "no", "falso", "sí", "No", "1", "0", "Si", "verdadero", "TRUE")


def written_date(ts: Column, key: Column) -> Column:
    """The date in one of twelve forms."""
    out = None
    for i, (spark_form, _) in enumerate(DATE_FORMS):
        written = F.date_format(ts, spark_form)
        out = F.when(key % 12 == i, written) if out is None else out.when(key % 12 == i, written)
    return out


def written_date_sql(ts: str, key: str) -> str:
    arms = " ".join(f"WHEN {i} THEN strftime({ts}, '{form}')" for i, (_, form) in enumerate(DATE_FORMS))
    return f"CASE {key} % 12 {arms} END"


def written_flag(key: Column) -> Column:
    """One of eleven spellings of a boolean, or null."""
    out = F.when(key % 13 == 12, F.lit(None).cast("string"))
    for i, word in enumerate(SPELLINGS):
        out = out.when(key % 11 == i, F.lit(word))
    return out


def written_flag_sql(key: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{word}'" for i, word in enumerate(SPELLINGS))
    return f"CASE WHEN {key} % 13 = 12 THEN NULL ELSE CASE {key} % 11 {arms} END END"


def _padded(value: Column, key: Column, at: int) -> Column:
    return F.when(key % 7 == at, F.concat(F.lit(" "), value, F.lit("\t"))).otherwise(value)


def _padded_sql(value: str, key: str, at: int) -> str:
    return f"CASE WHEN {key} % 7 = {at} THEN ' ' || {value} || chr(9) ELSE {value} END"


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey-like view over orders, customer, nation and region."""
    orders, customer = table(spark, sf_dir, "orders", spread=True), table(spark, sf_dir, "customer")
    customer = customer.withColumn("segment", F.initcap("c_mktsegment"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    key = F.col("o_orderkey")
    score = F.least(F.floor(F.col("o_totalprice") / 45000), F.lit(10)).cast("int")
    group = F.when(score >= 9, "Promotor").when(score >= 7, "Pasivo").otherwise("Detractor")
    churn = (
        F.when(F.col("o_orderstatus") == "F", "Bajo").when(F.col("o_orderstatus") == "O", "Medio")
        .otherwise("Alto")
    )
    comment = F.concat_ws(" ", F.lit("cliente"), "c_name", F.lit("router's"), "c_mktsegment", F.lit("señal & onda = 1"))
    comment = (
        F.when(key % 10 == 0, F.concat(F.lit("<script>alert('x')</script> "), comment))
        .when(key % 17 == 0, F.concat(F.lit("=@SUM(1,2) "), comment))
        .when(key % 19 == 0, F.concat(F.lit("  <img src=x onerror=alert(1)>"), comment))
        .otherwise(comment)
    )
    return joined.select(
        key.alias("answer_id"),
        F.concat(F.lit("CL"), "o_custkey").alias("id_cliente"),
        written_date(F.col("o_orderdate"), key).alias("fecha"),
        _padded(F.col("r_name"), key, 1).alias("region"),
        F.concat(F.lit("canal "), "o_orderstatus").alias("canal"),
        _padded(F.concat(F.lit("Fiber "), F.substring("o_orderpriority", 1, 1), F.lit("00")), key, 2).alias("plan"),
        _padded(F.lit("Móvil"), key, 3).alias("dispositivo"),
        comment.alias("comentario"),
        score.alias("NOTA"),
        _padded(group, key, 4).alias("NPS_GRUPO"),
        F.lit("Neutral").alias("sentimiento"),
        F.when(key % 3 != 0, F.col("segment")).alias("pain_points"),
        _padded(churn, key, 5).alias("churn_risk"),
        F.concat(F.lit("AG"), (F.col("o_custkey") % 97)).alias("agent_id"),
        written_flag(key).alias("outage_flag"),
        written_flag(key + 3).alias("fcr"),
        written_flag(key + 5).alias("sla_cumplido"),
        written_flag(key + 7).alias("facturacion_flag"),
        F.to_date("o_orderdate").alias("dia"),
    )


_SCORE = "CAST(least(floor(o_totalprice / 45000), 10) AS INTEGER)"
_GROUP = f"CASE WHEN {_SCORE} >= 9 THEN 'Promotor' WHEN {_SCORE} >= 7 THEN 'Pasivo' ELSE 'Detractor' END"
_CHURN = "CASE o_orderstatus WHEN 'F' THEN 'Bajo' WHEN 'O' THEN 'Medio' ELSE 'Alto' END"
_COMMENT = "('cliente ' || c_name || ' router''s ' || c_mktsegment || ' señal & onda = 1')"

SURVEY_SQL = f"""survey AS (
  SELECT o_orderkey AS answer_id, 'CL' || o_custkey AS id_cliente,
    {written_date_sql('o_orderdate', 'o_orderkey')} AS fecha,
    {_padded_sql('r_name', 'o_orderkey', 1)} AS region,
    'canal ' || o_orderstatus AS canal,
    {_padded_sql("('Fiber ' || substr(o_orderpriority, 1, 1) || '00')", 'o_orderkey', 2)} AS plan,
    {_padded_sql("'Móvil'", 'o_orderkey', 3)} AS dispositivo,
    CASE WHEN o_orderkey % 10 = 0 THEN '<script>alert(''x'')</script> ' || {_COMMENT}
         WHEN o_orderkey % 17 = 0 THEN '=@SUM(1,2) ' || {_COMMENT}
         WHEN o_orderkey % 19 = 0 THEN '  <img src=x onerror=alert(1)>' || {_COMMENT}
         ELSE {_COMMENT} END AS comentario,
    {_SCORE} AS "NOTA",
    {_padded_sql(f'({_GROUP})', 'o_orderkey', 4)} AS "NPS_GRUPO",
    'Neutral' AS sentimiento,
    CASE WHEN o_orderkey % 3 <> 0 THEN upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) END
      AS pain_points,
    {_padded_sql(f'({_CHURN})', 'o_orderkey', 5)} AS churn_risk,
    'AG' || (o_custkey % 97) AS agent_id,
    {written_flag_sql('o_orderkey')} AS outage_flag,
    {written_flag_sql('(o_orderkey + 3)')} AS fcr,
    {written_flag_sql('(o_orderkey + 5)')} AS sla_cumplido,
    {written_flag_sql('(o_orderkey + 7)')} AS facturacion_flag,
    CAST(o_orderdate AS DATE) AS dia
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

# --- the cleaning rules in SQL ----------------------------------------------------------

WHITE_SPACE_SQL = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(32)||chr(133)||chr(160)||chr(5760)"
    "||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)"
    "||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
)


def strip_sql(x: str) -> str:
    return f"trim({x}, {WHITE_SPACE_SQL})"


# Spellings of true and false, here and in the form of two values.
def boolean_sql(x: str) -> str:
    word = f"lower({strip_sql(x)})"
    return (
        f"CASE WHEN {word} IN ('1','true','yes','sí','si','verdadero','t','y') THEN true "
        f"WHEN {word} IN ('0','false','no','falso','f','n') THEN false END"
    )


def two_valued_sql(x: str) -> str:
    words = "'true','True','TRUE','si','Si','SI','sí','Sí','1','verdadero','Verdadero'"
    return f"coalesce({strip_sql(x)} IN ({words}), false)"


_D, _M = "(0?[1-9]|[12][0-9]|3[01])", "(0?[1-9]|1[0-2])"
_T = r"\s+(2[0-3]|[01]?[0-9]):[0-5]?[0-9]:[0-5]?[0-9]"
# Date shapes by name.
_SHAPES = {
    "Y-m-d": (rf"[0-9]{{4}}-{_M}-{_D}", "%Y-%m-%d"), "Y/m/d": (rf"[0-9]{{4}}/{_M}/{_D}", "%Y/%m/%d"),
    "d/m/Y": (rf"{_D}/{_M}/[0-9]{{4}}", "%d/%m/%Y"), "m/d/Y": (rf"{_M}/{_D}/[0-9]{{4}}", "%m/%d/%Y"),
    "d-m-Y": (rf"{_D}-{_M}-[0-9]{{4}}", "%d-%m-%Y"), "m-d-Y": (rf"{_M}-{_D}-[0-9]{{4}}", "%m-%d-%Y"),
    "Y-m-d time": (rf"[0-9]{{4}}-{_M}-{_D}{_T}", "%Y-%m-%d %H:%M:%S"),
    "d/m/Y time": (rf"{_D}/{_M}/[0-9]{{4}}{_T}", "%d/%m/%Y %H:%M:%S"),
    "m/d/Y time": (rf"{_M}/{_D}/[0-9]{{4}}{_T}", "%m/%d/%Y %H:%M:%S"),
    "y-m-d": (rf"[0-9]{{2}}-{_M}-{_D}", "%y-%m-%d"), "d/m/y": (rf"{_D}/{_M}/[0-9]{{2}}", "%d/%m/%y"),
    "m/d/y": (rf"{_M}/{_D}/[0-9]{{2}}", "%m/%d/%y"), "d-m-y": (rf"{_D}-{_M}-[0-9]{{2}}", "%d-%m-%y"),
    "m-d-y": (rf"{_M}-{_D}-[0-9]{{2}}", "%m-%d-%y"), "d.m.Y": (rf"{_D}\.{_M}\.[0-9]{{4}}", "%d.%m.%Y"),
    "d-b-Y": (rf"{_D}-[A-Za-z]{{3}}-[0-9]{{4}}", "%d-%b-%Y"),
}


def date_sql(x: str, formats: tuple[str, ...]) -> str:
    s = strip_sql(x)
    arms = ", ".join(
        f"CASE WHEN regexp_full_match({s}, '{_SHAPES[n][0]}') THEN try_strptime({s}, '{_SHAPES[n][1]}') END"
        for n in formats
    )
    return f"CAST(coalesce({arms}) AS DATE)"


def date_name_sql(x: str, formats: tuple[str, ...]) -> str:
    s = strip_sql(x)
    arms = " ".join(f"WHEN regexp_full_match({s}, '{_SHAPES[n][0]}') THEN '{n}'" for n in formats)
    return f"CASE WHEN {x} IS NULL THEN NULL {arms} ELSE 'other' END"


def _drop(x: str, pattern: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '', 'gis')"


# The injection patterns, as SQL.
_PATTERNS = (
    r"<script[^>]*>.*?</script>", r"javascript:", r"on[\p{L}\p{N}_]+\s*=", r"<iframe[^>]*>", r"<embed[^>]*>",
    r"<object[^>]*>", r"vbscript:", r"data:text/html", r"<svg[^>]*on[\p{L}\p{N}_]+", r"&#[0-9]+;",
    r"&#x[0-9a-fA-F]+;",
)


def escape_sql(x: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{raw}', '{entity}')"
    return x


def patterns_sql(x: str) -> str:
    for p in _PATTERNS:
        x = _drop(x, p)
    return x


def markup_sql(x: str, keep_unicode: bool = False) -> str:
    """The layers one by one: escape, all patterns, characters, strip."""
    x = patterns_sql(escape_sql(x))
    if not keep_unicode:
        x = f"regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g')"
    x = f"regexp_replace({x}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')"
    return strip_sql(x)


def formula_sql(x: str) -> str:
    s = strip_sql(x)
    return f"CASE WHEN substr({s}, 1, 1) IN ('=','+','-','@') THEN '''' || {s} ELSE {s} END"


def percent_sql(part: str, total: str, digits: int = 2) -> str:
    scale = 10 ** digits
    return (
        f"CASE WHEN {total} = 0 THEN 0.0 ELSE CAST(floor(CAST({part} AS DOUBLE) * {100 * scale}::DOUBLE"
        f" / CAST({total} AS DOUBLE) + 0.5::DOUBLE) AS DOUBLE) / {scale}::DOUBLE END"
    )


def ratio_sql(part: str, total: str, digits: int = 4) -> str:
    scale = 10 ** digits
    return (
        f"CASE WHEN {total} = 0 THEN 0.0 ELSE CAST(floor(CAST({part} AS DOUBLE) * {scale}::DOUBLE"
        f" / CAST({total} AS DOUBLE) + 0.5::DOUBLE) AS DOUBLE) / {scale}::DOUBLE END"
    )
