"""Checks on input files, as one job over many files.

The inventory holds one row per file, listed by tasks. Contents are read in ranges of bytes
(``sources.ranges``), so a file of any size is dealt over tasks; what a range cannot
know about itself, such as whether it begins inside quotes, is settled by composing what
the ranges report.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claravoz.functions import text
from claravoz.scratch import scratch_path
from claravoz.sources import csv_ranges, json_ranges
from claravoz.sources.csv_ranges import DELIMITERS
from claravoz.sources.ranges import RANGE_BYTES, UNDEFINED, Source, cut, list_files, read_ranges, task_count, valid_utf8, wide_encoding

# Accepted extensions and sizes.
EXTENSIONS = ("csv", "xlsx", "xls", "parquet", "json", "txt")
PROFILED = ("csv", "txt", "json")
MIN_BYTES = 1
MAX_BYTES = 100 * 1024 * 1024


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_name, extension, size_bytes, size_mb) of every file below ``path``.

    Folders are listed by tasks; files without a byte are there, too.
    """
    return list_files(spark, path).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("extension"),
        F.col("length").alias("size_bytes"),
        F.round(F.col("length") / (1024 * 1024), 2).alias("size_mb"),
    )


def _written(df: DataFrame, label: str) -> DataFrame:
    """``df`` in the scratch folder, for what is read more than once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_HEADERS = pa.list_(pa.struct([("delimiter", pa.string()), ("at", pa.int64()), ("fields", pa.list_(pa.string()))]))
_FACTS = pa.schema([
    ("path", pa.string()), ("start", pa.int64()), ("lead", pa.binary()), ("utf8", pa.bool_()), ("nul", pa.bool_()), ("undefined", pa.bool_()),
    ("control", pa.bool_()), ("shapes", csv_ranges.SHAPES), ("headers", _HEADERS), ("json", json_ranges.SUMMARY)])
_FACTS_DDL = ("path string, start long, lead binary, utf8 boolean, nul boolean, undefined boolean, control boolean, "
              f"shapes {csv_ranges.SHAPES_DDL}, headers array<struct<delimiter: string, at: long, fields: array<string>>>, json {json_ranges.SUMMARY_DDL}")


def _range_facts(source: Source, item: dict) -> Iterator[dict]:
    """What a task finds in a range, by the format that the file's name promises."""
    start, stop = item["start"], item["stop"]
    data = source.read(start, stop)
    wide = wide_encoding(source)
    utf8 = bool(wide) or valid_utf8(source, start, stop, data)
    row = {"path": item["path"], "start": start, "lead": data[:4] if start == 0 else None, "utf8": utf8, "nul": b"\0" in data and not wide,
           "undefined": not utf8 and any(bytes((b,)) in data for b in UNDEFINED),
           "control": not utf8 and any(bytes((b,)) in data for b in range(0x80, 0xA0)), "shapes": None, "headers": None, "json": None}
    if item["extension"] in ("csv", "txt"):
        row["shapes"] = csv_ranges.shapes(source, start, stop, wide)
        if start == 0:
            row["headers"] = [h for d in DELIMITERS if (h := csv_ranges.header_of(source, d, wide))]
    elif item["extension"] == "json":
        row["json"] = json_ranges.summary(source, start, stop, wide)
    yield row


def size_problem(size: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Reason when a file is empty or too large, else null."""
    return F.when(size < MIN_BYTES, "file is empty").when(size > max_bytes, "file too large")


def extension_problem(extension: Column, allowed: tuple[str, ...] = EXTENSIONS) -> Column:
    """Reason when the extension is not accepted, else null."""
    return F.when(~extension.isin(*allowed), F.lit("file type not allowed"))


def leading_kind(lead: Column) -> Column:
    """Kind of a file by its first bytes: parquet, zip (xlsx), ole (xls), else null."""
    lead = F.hex(F.substring(lead, 1, 4))
    return F.when(lead == "50415231", "parquet").when(lead == "504B0304", "zip").when(lead == "D0CF11E0", "ole")


def expected_kind(extension: Column) -> Column:
    """Kind that an extension promises."""
    return (
        F.when(extension == "parquet", "parquet").when(extension == "xlsx", "zip")
        .when(extension == "xls", "ole").otherwise("text")
    )


def encoding(lead: Column, utf8: Column, nul: Column, undefined: Column, control: Column, single_byte: bool = False) -> Column:
    """utf-8-sig, utf-16 or utf-8 by byte order mark and validity.

    With ``single_byte`` text that is not UTF-8 is windows-1252 if it has bytes 80 to 9F that
    are characters there, iso-8859-1 if it has none; zero bytes and bytes without a
    character make it unknown, as all such text is otherwise.
    """
    mark = F.hex(F.substring(lead, 1, 3))
    found = F.when(mark == "EFBBBF", "utf-8-sig").when(mark.rlike("^(FFFE|FEFF)"), "utf-16").when(utf8, "utf-8")
    if single_byte:
        found = found.when(~nul & ~undefined, F.when(control, "windows-1252").otherwise("iso-8859-1"))
    return found.otherwise("unknown")


def validate_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES,
                   check_content: bool = True) -> DataFrame:
    """Per file: the array of reasons against it and whether it passed."""
    files = file_inventory(spark, path)
    reasons = [
        size_problem(F.col("size_bytes"), max_bytes),
        extension_problem(F.col("extension")),
    ]
    if check_content:
        kind = expected_kind(F.col("extension"))
        listed = files.select("path", F.lit("").alias("extension"), F.when(kind == "text", F.col("size_bytes")).otherwise(
            F.least("size_bytes", F.lit(4))).alias("length"), kind.alias("_kind"))
        facts = read_ranges(*cut(listed), _range_facts, _FACTS_DDL, _FACTS)
        seen = facts.groupBy("path").agg(
            leading_kind(F.max("lead")).alias("_leading"), (F.bool_and("utf8") & ~F.bool_or("nul")).alias("_text"))
        files = files.join(seen, "path", "left")
        found = F.coalesce("_leading", F.when(F.col("_text"), "text").otherwise("binary"))
        reasons.append(F.when((F.col("size_bytes") > 0) & (found != kind), F.lit("content does not match extension")))
    found = F.concat(F.array_compact(F.array(*reasons)), text.file_name_problems(F.col("file_name")))
    return files.withColumn("errors", found).withColumn("passed", F.size("errors") == 0) \
        .select("path", "file_name", "extension", "size_bytes", "errors", "passed")


def csv_layout(facts: DataFrame, delimiter: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, known) of CSV files by their ranges' facts.

    Files: path, delimiter, rows, header, header_at, uneven_rows, multi_line, open_quote. Known: path,
    start, delimiter, entry (1 if a range begins inside quotes), for each delimiter. A given
    ``delimiter`` is not looked for.
    """
    tables = facts.where("shapes IS NOT NULL")
    known = csv_ranges.true_shapes(tables)
    known = _written(known if delimiter is None else known.where(F.col("delimiter") == delimiter), "shapes")
    headers = tables.where("headers IS NOT NULL").select("path", F.inline("headers")).withColumnsRenamed({"fields": "header", "at": "header_at"})
    chosen = csv_ranges.chosen_delimiters(csv_ranges.row_lengths(known), headers)
    quotes = known.groupBy("path", "delimiter").agg(
        F.bool_or("now.breaks").alias("multi_line"), (F.max_by("now.exit", "start") == 1).alias("open_quote"))
    return chosen.join(quotes, ["path", "delimiter"]), known.select("path", "start", "delimiter", "entry")


def json_layout(facts: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, ranges) of JSON files: path, lines, several, opening, balanced; and the ranges with all
    that ``json_ranges.values`` asks for."""
    entries, files = json_ranges.layouts(facts.where("json IS NOT NULL"))
    files = _written(files, "layouts")
    return files, _written(ranges.join(entries, ["path", "start"]).join(files, "path"), "entries")


def json_facts(files: DataFrame, values: DataFrame) -> DataFrame:
    """(path, json_problem, json_rows, json_multi_line): whether each file is one document, or one a line.

    Every value at the top is parsed on its own. Rows are the elements of a list.
    """
    blank = F.trim("record", F.lit(" \t\r\n")) == ""
    member = F.concat(F.lit("{"), F.col("record"), F.lit("}"))
    bad = (F.col("kind") == "bad") | blank | json_problem(F.when(F.col("kind") == "member", member).otherwise(F.col("record"))).isNotNull()
    seen = values.groupBy("path").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(bad).alias("_bad"), F.sum(F.when(F.col("kind") == "element", 1).otherwise(0)).alias("_elements"),
        F.bool_and(F.col("kind").isin("element", "member") & blank).alias("_hollow"))
    empty = (F.col("_n") == 1) & F.col("_hollow")
    right = F.col("_n").isNotNull() & (F.col("lines") & ~F.col("_bad") | ~F.col("lines") & F.col("balanced") & (empty | ~F.col("_bad")))
    rows = F.when(right & ~F.col("lines") & ~empty, F.col("_elements")).otherwise(0).cast("int")
    return files.join(seen, "path", "left").select(
        "path", F.when(~right, F.lit("invalid JSON")).alias("json_problem"), rows.alias("json_rows"),
        (~F.col("lines") & (F.col("several") | (rows > 0) | ~right)).alias("json_multi_line"))


@dataclass(frozen=True)
class Profile:
    """The profile of files, the ranges that a second pass reads their rows from, and its tasks."""

    files: DataFrame
    csv_ranges: DataFrame
    json_ranges: DataFrame | None
    tasks: int


def profile(spark: SparkSession, path: str, expect_header: bool = True, min_rows: int = 1,
            max_bytes: int | None = None, single_byte: bool = True, delimiter: str | None = None,
            range_bytes: int = RANGE_BYTES) -> Profile:
    """Profile the files below ``path`` by ranges of bytes, each read once; JSON values are
    read once more. Files of any size are dealt over tasks, and no file is a row."""
    files = file_inventory(spark, path).select("path", "extension", "size_bytes")
    wanted = files if max_bytes is None else files.where(F.col("size_bytes") <= max_bytes)
    ranges, tasks = cut(wanted.select("path", "extension", F.col("size_bytes").alias("length")), range_bytes)
    facts = _written(read_ranges(ranges, tasks, _range_facts, _FACTS_DDL, _FACTS), "facts")
    found = facts.groupBy("path").agg(
        F.max("lead").alias("lead"), F.bool_and("utf8").alias("utf8"), *(F.bool_or(c).alias(c) for c in ("nul", "undefined", "control")))
    coded = found.select("path", encoding(*map(F.col, ("lead", "utf8", "nul", "undefined", "control")), single_byte).alias("encoding"))
    tables, known = csv_layout(facts, delimiter)
    judged, parts = spark.createDataFrame([], "path string, json_problem string, json_rows int, json_multi_line boolean"), None
    if not facts.where("json IS NOT NULL").isEmpty():
        documents, parts = json_layout(facts, ranges.join(coded, "path"))
        judged = json_facts(documents, json_ranges.values(parts, tasks))
    is_csv, is_json = F.col("extension").isin("csv", "txt"), F.col("extension") == "json"
    read = F.lit(True) if max_bytes is None else F.col("size_bytes") <= max_bytes
    joined = files.join(coded, "path", "left").join(tables, "path", "left").join(judged, "path", "left")
    profiled = joined.select(
        "path", "size_bytes", F.when(F.col("size_bytes") == 0, "utf-8").otherwise(F.coalesce("encoding", F.lit("unknown"))).alias("encoding"),
        read.alias("_read"), F.when(is_csv, "csv").when(is_json, "json").otherwise("unknown").alias("format"), "delimiter", "header", "header_at",
        F.coalesce("rows", F.when(is_json, F.col("json_rows")), F.when(read, 0)).cast("int").alias("rows"), "uneven_rows",
        F.coalesce("multi_line", "json_multi_line", F.when(read & (is_csv | is_json), F.lit(False))).alias("multi_line"), "open_quote", "json_problem")
    is_csv = F.col("format") == "csv"
    errors = F.array_compact(F.array(
        F.when(F.col("size_bytes") < MIN_BYTES, F.lit("file is empty")),
        F.when(F.col("format") == "unknown", F.lit("unsupported file format")),
        F.when((F.col("encoding") == "unknown") & (F.col("size_bytes") > 0) & F.col("_read"),
               F.lit("not valid UTF-8")),
        F.when(is_csv & (F.col("uneven_rows") > 0),
               F.format_string("%d rows differ from the header in length", F.col("uneven_rows"))),
        F.when(F.col("open_quote"), F.lit("quote is not closed")),
        F.when(is_csv & (F.col("rows") < min_rows), F.lit("insufficient rows")),
        F.when(is_csv & F.col("_read") & F.lit(expect_header) & F.col("header").isNull(), F.lit("header expected but not found")),
        # one document, or one document a line
        F.col("json_problem"),
    ))
    every = profiled.withColumn("errors", errors).withColumn("passed", F.size("errors") == 0)
    written = _written(every.drop("_read", "open_quote", "json_problem"), "profile")
    layout = written.select("path", "encoding", "delimiter", "header", "header_at")
    return Profile(written, ranges.join(layout, "path").join(known, ["path", "start", "delimiter"]), parts, tasks)


def profile_files(spark: SparkSession, path: str, expect_header: bool = True, min_rows: int = 1,
                  max_bytes: int | None = None, single_byte: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per file: encoding, format, delimiter, header, row count, errors, passed.

    Rows are counted with the header; a line end inside quotes ends none, and blank
    lines are none. All rows are compared with the header's length. Also says whether
    quotes hold line breaks. Files beyond ``max_bytes`` are listed without these facts.
    ``single_byte`` accepts text in Windows-1252 and Latin-1, too.
    """
    return profile(spark, path, expect_header, min_rows, max_bytes, single_byte, range_bytes=range_bytes).files.select(
        "path", "size_bytes", "encoding", "format", "delimiter", "header", "rows", "uneven_rows",
        "multi_line", "errors", "passed")


def json_problem(document: Column) -> Column:
    """Reason when a text is not one whole JSON document, else null.

    The parser stops after the first value, so the text is read as the only element
    of a list: more values, or anything else behind the first, break that.
    """
    listed = F.concat(F.lit("["), document, F.lit("]"))
    return F.when(
        document.isNull() | F.try_parse_json(document).isNull() | F.try_parse_json(listed).isNull()
        | (F.coalesce(F.json_array_length(listed), F.lit(0)) != 1), F.lit("invalid JSON"))


def json_rows(document: Column) -> Column:
    """Number of elements when the document is a list, else zero."""
    return F.coalesce(F.json_array_length(document), F.lit(0))


_TEXT = pa.schema([("path", pa.string()), ("record", pa.string())])


def _beginnings(source: Source, item: dict) -> Iterator[dict]:
    """The first characters of a file."""
    data, wide = source.read(0, 4 * (item["chars"] + 1)), wide_encoding(source)
    yield {"path": item["path"], "record": data.decode("utf-16" if wide else "utf-8", "replace")[:item["chars"]]}


def malicious_preview(spark: SparkSession, path: str, preview_chars: int | None = None,
                      max_bytes: int | None = None) -> DataFrame:
    """CSV files with a record that matches a script pattern, or that begin like a formula; all
    files unless a limit is given.

    Whole files are searched record by record, unless ``preview_chars`` limits the search
    to their beginning.
    """
    pattern = "(?i)" + "|".join(text.COMMENT_PATTERNS)
    files = file_inventory(spark, path).where("extension = 'csv' AND size_bytes > 0").select("path", "extension", F.col("size_bytes").alias("length"))
    files = files if max_bytes is None else files.where(F.col("length") <= max_bytes)
    formula = r"^[=@+\-]"
    if preview_chars is not None:
        heads = files.select("path", F.lit(0).alias("start"), F.lit(preview_chars).alias("chars"))
        first = read_ranges(heads, task_count(spark, files.count()), _beginnings, "path string, record string", _TEXT)
        return first.select("path", (F.col("record").rlike(pattern) | F.col("record").rlike(formula)).alias("malicious"))
    ranges, tasks = cut(files)
    facts = _written(read_ranges(ranges, tasks, _range_facts, _FACTS_DDL, _FACTS), "facts")
    tables, known = csv_layout(facts)
    entries = known.join(tables.select("path", "delimiter"), ["path", "delimiter"])
    found = csv_ranges.records(ranges.withColumn("encoding", F.lit("utf-8")).join(entries, ["path", "start"]), tasks)
    seen = found.groupBy("path").agg(
        F.bool_or(F.col("record").rlike(pattern)).alias("_script"),
        F.min_by(F.col("record").rlike(formula), "offset").alias("_formula"))
    return files.select("path").join(seen, "path", "left").select("path", F.coalesce(F.col("_script") | F.col("_formula"), F.lit(False)).alias("malicious"))
