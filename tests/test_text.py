import datetime
import html
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claravoz.functions import dates, scoring, text, vectors
from claravoz.functions.sql import register
from claravoz.operators import quality, schema


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_strip_takes_all_white_space(spark):
    got = apply(spark, text.strip, ["  a b ", "  x　\n", "\t", "", None, "a"])
    assert got == ["a b", "x", "", "", None, "a"]
    assert apply(spark, text.is_padded, [" a", "a", "a ", None]) == [True, False, True, None]


def test_boolean_spellings(spark):
    true = ["1", "true", "yes", "sí", "si", "verdadero", "t", "y", " SÍ ", "TRUE"]
    false = ["0", "false", "no", "falso", "f", "n", "No", " FALSO"]
    assert apply(spark, text.normalize_boolean, true) == [True] * len(true)
    assert apply(spark, text.normalize_boolean, false) == [False] * len(false)
    assert apply(spark, text.normalize_boolean, ["", "  ", None, "maybe", "10"]) == [None] * 5
    typed = spark.createDataFrame([(0, 0.0, True), (3, 2.5, False)], "i int, d double, b boolean")
    types = {f.name: f.dataType for f in typed.schema.fields}
    rows = typed.select(*(text.normalize_boolean(F.col(c), types[c]).alias(c) for c in "idb")).collect()
    assert [tuple(r) for r in rows] == [(False, False, True), (True, True, False)]


def test_two_valued_boolean(spark):
    got = apply(spark, text.two_valued_boolean, [" Si ", "verdadero", "1", "yes", "no", None, "¿?"])
    assert got == [True, True, True, False, False, False, False]


@pytest.mark.parametrize("raw, clean", [
    ("<script>go('now')</script>", "&lt;script&gt;go(now)&lt;/script&gt;"),
    ("<p onclick=go(2)>", "&lt;p go(2)&gt;"),
    ("don't conclusion = 5 señor", "dont c 5 seor"),
    ("", ""), ("   ", ""), (None, None),
    ("a & b", "a &amp; b"), ("&#60;b&#62;", "&amp;#60;b&amp;#62;"),
    ("x\x00y\x07z\n\tw", "xyz\n\tw"),
])
def test_markup_exact(spark, raw, clean):
    assert apply(spark, text.sanitize_markup, [raw]) == [clean]


#: Live markup that must not survive, and the part of it that a browser would act on.
LIVE = [
    ("Hola <script type=text/plain>steal()</script> mundo", "<script"), ("<ScRiPt>go()</sCrIpT>", "<script"),
    ("<p onmouseover = go()>hi</p>", "onmouseover"), ("<video onplay=go()>", "onplay="), ("see JavaScript:go()", "javascript:"),
    ("VBScript:go", "vbscript:"), ("<iframe width=1 height=1>", "<iframe"), ("<object data=x>", "<object"), ("<embed src=x>", "<embed"),
    ("<svg/onbegin=go()>", "onbegin="), ("open data:text/html;base64,AAAA", "data:text/html"),
]


def test_live_markup_is_gone(spark):
    for (raw, live), got in zip(LIVE, apply(spark, text.sanitize_markup, [raw for raw, _ in LIVE])):
        assert live not in got.lower() and "<" not in got, raw


def test_plain_sentences_stay(spark):
    plain = ["Delivery took 3 days, 2 too many.", "Call me: 555 0101", "(see page 4)", "50% off / today only", "a-b_c. d; e!"]
    assert apply(spark, text.sanitize_markup, plain) == plain


def test_keep_unicode_and_no_cap(spark):
    keep = apply(spark, lambda c: text.sanitize_markup(c, "keep_unicode"), ["año <i>"])
    assert keep == ["año &lt;i&gt;"]
    long = "b" * 60_000 + "<script>x</script>" + "c"
    got = apply(spark, text.sanitize_markup, [long])[0]
    assert got.startswith("b" * 60_000) and got.endswith("c") and "<" not in got
    assert [len(x) for x in apply(spark, lambda c: text.sanitize_markup(c, max_length=10), [long])] == [10]


@pytest.mark.parametrize("cell, escaped", [
    ("=SUM(B2:B9)", True), ("+34 600 000 000", True), ("-5", True), ("@here", True), ("  =A1", True), ("\n-x", True),
    ("A=1", False), ("5-3", False), ("mail@host", False), ("", False),
])
def test_formula_escape(spark, cell, escaped):
    got = apply(spark, text.escape_formula, [cell])[0]
    assert got == ("'" + cell.strip() if escaped else cell)


def test_dangerous_formula(spark):
    got = apply(spark, text.has_dangerous_formula, ["=EXEC(A1)", "@dde(x)", "=A1+B1", "exec", "-ImportData(u)"])
    assert got == [True, True, False, False, True]


def test_comment_sanitisers(spark):
    got = apply(spark, text.clean_comment, ["<script>x</script>ok ", "=@SUM(1,2) Contento", "=1", None])
    assert got == ["ok", "Contento", "=1", None]
    got = apply(spark, text.guard_comment, ["<iframe a>b</iframe>c", "=x", "a onload=b ", "", None])
    assert got == ["c", "'=x", "a b", "", None]


def test_attack_classes_and_pain_points(spark):
    assert apply(spark, text.attack_classes, ["<script>", "=1", "a onx = 1", "fine", "&#60;"]) == [
        ["script"], ["formula"], ["event_handler"], [], ["entity"]]
    filled = apply(spark, lambda c: text.fill_pain_point(F.lit(None).cast("string"), c),
                   ["Problema de FACTURACIÓN", "nada", None])
    assert filled == ["Facturación", "unspecified", "unspecified"]


def test_file_names(spark):
    assert apply(spark, text.safe_file_name, ["a bñ.csv", "x/../y z.csv"]) == ["a_bñ.csv", "y_z.csv"]
    got = apply(spark, text.file_name_problems, ["ok.csv", "../x", "", "a" * 256, "a\x00b"])
    assert got == [[], ["path traversal"], ["empty"], ["too long"], ["null byte"]]


PIECES = st.sampled_from(["<b", ">", "/", "on", "q", "ü", "=", " ", "'", '"', "&", "#", "7", ";", "<", "script", ":", "java", "é",
                          "\t", "\x02", "ß", "lt", "Z", "\x7f", "_", "(", ")"])


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=40, max_size=80))
def test_markup_properties(spark, values):
    """What holds for every result: nothing a browser reads as markup, only printable
    ASCII and line ends, no blanks around it, and no growth but by entities."""
    for raw, got in zip(values, apply(spark, text.sanitize_markup, values)):
        assert not set(got) & set("<>'\""), raw
        assert all(c in "\t\n\r" or " " <= c <= "\x7f" for c in got), raw
        assert got == got.strip()
        assert len(html.unescape(got)) <= len(raw)
        assert re.search(r"&(?!amp;|lt;|gt;|quot;)", got) is None, raw
    # text of letters, digits, blanks and points has nothing to lose
    harmless = ["".join(c for c in v if c.isascii() and (c.isalnum() or c == " ")) for v in values]
    assert apply(spark, text.sanitize_markup, harmless) == [h.strip() for h in harmless]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=12), min_size=20, max_size=40))
def test_strip_and_boolean_are_idempotent(spark, values):
    once = apply(spark, text.strip, values)
    assert apply(spark, text.strip, once) == once
    flags = [None if b is None else str(b) for b in apply(spark, text.normalize_boolean, values)]
    again = apply(spark, text.normalize_boolean, flags)
    assert [None if b is None else str(b) for b in again] == flags


DAYS = st.dates(min_value=datetime.date(1970, 1, 1), max_value=datetime.date(2068, 12, 31))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(DAYS, min_size=20, max_size=40))
def test_dates_are_read_back(spark, days):
    """Every day is written in each shape and read back; a day up to the 12th, written
    month first, is read day first."""
    def written(day, month, year, shape):
        return shape.replace("D", f"{day:02d}").replace("M", f"{month:02d}").replace("Y", f"{year:04d}").replace("y", f"{year % 100:02d}")

    for shape in ("Y-M-D", "Y/M/D", "D/M/Y", "D-M-Y", "Y-M-D 01:02:03", "D/M/Y 23:59:59", " D/M/Y ", "D/M/y"):
        texts = [written(d.day, d.month, d.year, shape) for d in days]
        assert apply(spark, dates.iso_date, texts) == [d.isoformat() for d in days], shape
    for shape in ("M/D/Y", "M-D-Y", "M/D/Y 00:00:00", "M/D/y"):
        texts = [written(d.day, d.month, d.year, shape) for d in days]
        swapped = [d.replace(day=d.month, month=d.day) if d.day <= 12 else d for d in days]
        assert apply(spark, dates.iso_date, texts) == [d.isoformat() for d in swapped], shape
    spoiled = [f"{d.isoformat()}x" for d in days] + [f"{d.year}.{d.month}.{d.day}" for d in days] + [f"{d.year}-13-{d.day}" for d in days]
    assert set(apply(spark, dates.iso_date, spoiled)) == {None}


def test_dates_exact(spark):
    got = apply(spark, dates.iso_date, ["2024-01-15", "2024/01/16", "15-01-2024", "2024-01-17 10:30:00",
                                        "06-07-25", "01/25/24", "", None, "x", "70-01-02", "30/02/2024"])
    assert got == ["2024-01-15", "2024-01-16", "2024-01-15", "2024-01-17", "2006-07-25", "2024-01-25",
                   None, None, None, "1970-01-02", None]
    survey = apply(spark, lambda c: dates.iso_date(c, dates.SURVEY_FORMATS),
                   ["06-07-25", "10-16-25", "06-May-2025", "01.08.2025"])
    assert survey == ["2025-07-06", "2025-10-16", "2025-05-06", "2025-08-01"]
    names = apply(spark, dates.date_format_name, ["2024-01-15", "31/12/24", "06-May-2025", "nope", None])
    assert names == ["Y-m-d", "d/m/y", "d-b-Y", "other", None]


def test_scores(spark):
    row = spark.range(1).select(
        scoring.softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("s"),
        scoring.sentiment(F.lit(.9), F.lit(.1)).alias("p"), scoring.sentiment(F.lit(.5), F.lit(.5)).alias("t"),
        scoring.confidence(F.lit(.35), F.lit(.65)).alias("c"),
        scoring.five_class_label(F.array(*(F.lit(x) for x in (.1, .2, .5, .1, .1)))).alias("f"),
        scoring.percent(F.lit(1), F.lit(3)).alias("pct"), scoring.percent(F.lit(1), F.lit(0)).alias("zero"),
        vectors.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"),
        vectors.unit(F.array(F.lit(0.0), F.lit(0.0))).alias("z"),
    ).first()
    assert row["s"] == [.5, .5] and (row["p"], row["t"], row["c"]) == ("POSITIVE", "NEGATIVE", .65)
    assert row["f"] == "Neutral" and row["pct"] == 33.33 and row["zero"] == 0.0
    assert row["u"] == [.6, .8] and row["z"] == [0.0, 0.0]
    plans = {"Fiber 100": (19923, 12146, 6483, 2729, 42.99), "Fiber 300": (19910, 9383, 4413, 2553, 32.78),
             "Fiber 500": (14334, 5615, 2477, 1750, 27.21), "Fiber 1000": (2833, 911, 388, 322, 22.46)}
    for total, d, h, m, score in plans.values():
        got = spark.range(1).select(scoring.severity_score(
            F.lit(d / total * 100), F.lit(h / total * 100), F.lit(m / total * 100))).first()[0]
        assert abs(got - score) < 0.06
    assert apply(spark, scoring.severity_level, [40.0, 39.9, 30.0, 20.0, 19.9], "double") == [
        "critical", "high", "high", "medium", "low"]


def test_sql_functions_have_no_python(spark):
    names = register(spark)
    assert "clean_text" in names
    df = spark.sql("SELECT clean_text('=1 <b>') AS t, clean_boolean(' Si ') AS b, "
                   "CAST(clean_date('15/01/2024') AS STRING) AS d, clean_strip(' x ') AS s, "
                   "severity_level(41D) AS l, attack_classes('<script>') AS a")
    assert tuple(df.first()) == ("'=1 &lt;b&gt;", True, "2024-01-15", "x", "critical", ["script"])
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


ODD_TEXTS = (
    None, "", " ", "\u2003\x0b plain \xa0", "\x1c\u2003=1+1", " -5", "@x", "+", "Fiber 100", "A&B", "it's <b>\"x\"", "onda = 1", "on\u2003=",
    "  javascript:alert(1)", "\x85on\u0131x=\x1f", "data:text/html,\x7f", "se\xf1al", "\ttab\n", "a\x00=b", "\u3000", "x:\ud7ff", "= on a=", "&#39;", "\u00a0-\u00a0", "vb\u017fcript:",
    "\U0001f600", "S\xcd", "\u0130", "\u212a", "\u017f\xed", "verdadero", "VERDADEROS", "\u0661/01/2024", "1/2/2024", "2024-1-1 1:2:3", "2024-13-01", "1", " No ",
)


@pytest.mark.parametrize("mode", ["strict", "keep_unicode"])
def test_untouched_text_skips_steps_with_the_same_result(spark, mode):
    df = spark.createDataFrame([(x,) for x in ODD_TEXTS], "x string")
    safe = text.drop_unsafe_characters(text._drop_plain_patterns(text.strip(F.col("x"))), keep_unicode=mode == "keep_unicode")
    layered = text.escape_formula(text.script_strip(text._replace_all(safe, (("'", ""), *text._MARKUP_ENTITIES))))
    cleaned = schema.cleaning_columns(df, {}, mode=mode)["x"][0]
    got = df.select(layered.alias("want"), cleaned.alias("got"), text.sanitize_text(F.col("x"), True, mode).alias("plain")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got] == [r["plain"] for r in got]


def test_detection_flags_agree_with_the_parsers(spark):
    df = spark.createDataFrame([(x,) for x in ODD_TEXTS], "x string")
    bare = text.strip(F.col("x"))
    flags = [F.coalesce(quality.DETECTION_FLAGS[name](F.col("x"), bare), F.lit(False)) for name in ("boolean_like", "date_like", "whitespace_count")]
    wants = [text.normalize_boolean(bare, stripped=True).isNotNull(), dates.parse_date(bare, stripped=True).isNotNull(),
             F.coalesce(F.length("x") != F.length(bare), F.lit(False))]
    rows = df.select(F.array(*flags).alias("got"), F.array(*wants).alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert all(any(r["want"][i] for r in rows) for i in range(3))


@pytest.mark.parametrize("kind", ["string", "date", "boolean"])
def test_cleaning_of_many_columns_is_compiled(spark, tmp_path, kind):
    names = [f"c{i}" for i in range(8)]
    spark.range(4).select(*(F.col("id").cast("string").alias(n) for n in names)).write.parquet(str(tmp_path / "t"))
    plan = schema.clean(spark.read.parquet(str(tmp_path / "t")), dict.fromkeys(names, kind))._jdf.queryExecution().executedPlan()
    stages = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(plan)
    # HotSpot compiles no method of more than 8,000 bytes
    assert all(stages.apply(i)._3().maxMethodCodeSize() <= 8000 for i in range(stages.size()))
