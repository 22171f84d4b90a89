"""WARC archives: writing, reading back, and resolving copies to revisit records.

A record is a version line, named fields, an empty line, a block of Content-Length
bytes and two line ends. The first field of every record that is written here is
``WARC-Archive``, an extension field with a random name of the archive. Version line
and that field together are a separator that no payload can hold by chance or intent,
as it is drawn after the payloads are there. So Spark's text source, told to split at
it, reads a record per row: archives of any size are cut over tasks, no file is a row,
and whatever store Spark reaches will do. Archives by others are split at a version
line; a record whose block is not as long as it says is marked damaged.

Copies are found from headers alone. They are grouped by payload digest; of equal ones
the record with the smallest page id is the original response, the others become
revisit records that name it. Writing the resolved archive takes payloads from
the first one, each once, and gives every record fresh fields.

The text source writes bytes as they are, also such as are not UTF-8. All is in
DataFrame functions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claravoz.llm.tables import join_by_run, stored
from claravoz.scratch import scratch_path

END = "\r\n"
VERSION = "WARC/1.1" + END
#: Fixed value: the profile of a revisit record by equal payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Digits of base 32 in arithmetic and in the encoding of bytes.
_COUNTED, _WRITTEN = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

HEADERS = ["record_id", "page_id", "uri", "date", "payload_digest", "payload_bytes"]


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary column in upper-case base 32: four digits for each five of base 16."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _COUNTED, _WRITTEN)


def _line(name: str, value: Column | str) -> Column:
    """A field, or nothing where the value is null. Line ends in a value would end the field."""
    value = F.lit(value) if isinstance(value, str) else F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records_of(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """A response record for every row: headers and payload (binary; null is empty).

    Record ids tell rows apart, also where keys are null or repeat; they belong to the
    rows once these are written.
    """
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    number = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    name = uuid.uuid4().hex[:16]
    found = pages.select(F.col(key).cast("long").alias("page_id"), F.col(uri).cast("string").alias("uri"), data.alias("payload"))
    whole = F.concat(F.lit(name), F.lower(number))
    dashed = F.concat_ws("-", *(F.substring(whole, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return found.select(
        F.concat(F.lit("urn:uuid:"), dashed).alias("record_id"), "page_id", "uri",
        _now().alias("date"),
        base32_sha1(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.lit("response").alias("record_type"), *(F.lit(None).cast(t).alias(c) for c, t in REFERS.items()), "payload")


#: What a revisit record says of the original response.
REFERS = {"refers_to_record": "string", "refers_to": "long", "refers_to_uri": "string", "refers_to_date": "string"}


def write_archive(records: DataFrame, path: str, compression: str | None = "gzip") -> str:
    """Write records (``HEADERS``, ``record_type``, ``REFERS``, ``payload``) as WARC files below ``path``.

    A response has its payload behind HTTP headers in its block, a revisit the HTTP
    headers only. One file for each task, committed by Spark when the task is done.
    Gzip files are one stream each; without compression a file of any size is read by
    many tasks.
    """
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"),
                    _line("Content-Length", F.col("payload_bytes")), F.lit(END))
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col("payload").cast("string"), F.lit("")))
    angled = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    block = F.concat(http, body)
    fields = F.concat(
        _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", angled("record_id")),
        _line("WARC-Date", F.col("date")), _line("WARC-Target-URI", F.col("uri")), _line("WARC-Page-ID", F.col("page_id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(
            _line("WARC-Profile", PROFILE), _line("WARC-Refers-To", angled("refers_to_record")),
            _line("WARC-Refers-To-Target-URI", F.col("refers_to_uri")), _line("WARC-Refers-To-Date", F.col("refers_to_date")),
            _line("WARC-Refers-To-Page-ID", F.col("refers_to")))).otherwise(F.lit("")),
        _line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", F.octet_length("_block")))
    start = VERSION + f"WARC-Archive: {uuid.uuid4().hex}{END}"
    text = records.withColumn("_block", block).select(F.concat(F.lit(start), fields, F.lit(END), "_block").alias("value"))
    text.write.option("compression", compression or "none").option("lineSep", END + END).text(path)
    return path


def _separator(spark: SparkSession, path: str) -> str | None:
    """Version line and archive field of an archive written here, from its first record,
    the version line of another; null of an empty archive."""
    first = spark.read.option("lineSep", END).text(path).where("value != ''").limit(2).collect()
    lines = [r["value"] for r in first]
    if not lines:
        return None
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC archive: {path}")
    own = len(lines) > 1 and lines[1].startswith("WARC-Archive: ")
    return END.join([*lines[:1 + own], ""])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archive (one, of any number of files) below ``path``: ``HEADERS``, ``record_type``, ``REFERS``,
    ``payload`` (null of a revisit) and ``damaged``.

    ``payload_bytes`` and ``payload_digest`` are of the full payload: what a revisit says
    of it, and what is counted anew of a response. A record is damaged if its block is
    shorter or longer than its header says, or its payload is not the one of its digest.
    A missing field is null. Payloads that are not asked for are not looked at.
    """
    separator = _separator(spark, path)
    source = spark.read.option("lineSep", separator or END).text(path).where("value != ''")
    cut = F.instr("value", END + END)
    parsed = source.select(F.concat(F.lit(END), F.substring("value", F.lit(1), cut + 1)).alias("_head"),
                           F.col("value").cast("binary").alias("_bytes"))

    def field(name: str) -> Column:
        found = F.regexp_extract("_head", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
        return F.when(found != "", found)

    size = field("Content-Length").try_cast("int")
    at = F.octet_length("_head")  # one line end was added in front, the empty line comes behind
    block = F.substring("_bytes", at + 1, size)
    shown = parsed.select(
        F.regexp_replace(field("WARC-Record-ID"), "[<>]", "").alias("record_id"), field("WARC-Page-ID").try_cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("uri"), field("WARC-Date").alias("date"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("_said"), field("WARC-Type").alias("record_type"),
        F.regexp_replace(field("WARC-Refers-To"), "[<>]", "").alias("refers_to_record"),
        field("WARC-Refers-To-Page-ID").try_cast("long").alias("refers_to"), field("WARC-Refers-To-Target-URI").alias("refers_to_uri"),
        field("WARC-Refers-To-Date").alias("refers_to_date"), (size != F.octet_length("_bytes") - at - 4).alias("_uneven"), block.alias("_block"))
    text = F.col("_block").cast("string")
    http = F.instr(text, END + END)
    known = shown.where("record_type IN ('response', 'revisit')").withColumn(
        "_http", F.when(http > 0, F.substring(text, F.lit(1), http + 3)).otherwise(F.when(F.col("record_type") == "revisit", text).otherwise("")))
    told = F.regexp_extract("_http", r"(?i)\r\nContent-Length:[ \t]*([0-9]+)", 1).try_cast("long")
    rest = F.substring("_block", F.octet_length("_http") + 1, F.octet_length("_block"))
    with_payload = known.withColumns({"payload": F.when(F.col("record_type") == "response", rest), "_told": told})
    digest = F.coalesce(base32_sha1(F.col("payload")), "_said")
    return with_payload.select(
        "record_id", "page_id", "uri", "date", digest.alias("payload_digest"),
        F.coalesce(F.octet_length("payload").cast("long"), "_told").alias("payload_bytes"), "record_type", *REFERS, "payload",
        (F.coalesce("_uneven", F.lit(True)) | F.coalesce(digest != F.col("_said"), F.lit(False))).alias("damaged"))


def revisits(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``record_id`` and ``REFERS`` of the records of ``headers`` that revisit another.

    Equal are records of the same payload digest. The response with the smallest page id
    (null last, then record id) is the original. Every other response of ``least_bytes``
    and more revisits it, and a record that was a revisit before is joined to it. A
    revisit without a response stays as it is.

    Headers are grouped by digest; each task then looks up the digests that it has, so
    a digest that a third of all records share is never gathered. Record ids are unique,
    as the format demands.
    """
    asked = headers.select(*HEADERS, "record_type").withColumn("run", F.spark_partition_id())
    rows = stored(asked.where(F.col("payload_digest").isNotNull()), "headers")
    response = F.col("record_type") == "response"
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "uri", "date")
    originals = (rows.groupBy("payload_digest").agg(F.min(F.when(response, order)).alias("_first"), F.count(F.lit(1)).alias("_n"))
                 .where("_n > 1 AND _first IS NOT NULL").drop("_n"))
    later = join_by_run(rows, "payload_digest", originals).where(
        (F.col("record_id") != F.col("_first.record_id")) & (~response | (F.col("payload_bytes") >= least_bytes)))
    return stored(later.select(
        "record_id", F.col("_first.record_id").alias("refers_to_record"), F.col("_first.page_id").alias("refers_to"),
        F.col("_first.uri").alias("refers_to_uri"), F.col("_first.date").alias("refers_to_date")), "revisits")


def resolve(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``records`` with ``record_type`` and ``REFERS`` as ``revisits`` finds them, and no payload in a revisit.

    The records move only if the found ones, joined by record id, do not fit a broadcast.
    """
    found = revisits(records, least_bytes).select("record_id", *(F.col(c).alias(f"_{c}") for c in REFERS))
    now = F.col("_refers_to_record").isNotNull()
    changed = {"record_type": F.when(now, "revisit").otherwise(F.col("record_type"))}
    changed |= {c: F.when(now, F.col(f"_{c}")).otherwise(F.col(c)) for c in REFERS}
    if "payload" in records.columns:
        changed["payload"] = F.when(~now, F.col("payload"))
    return records.join(found, "record_id", "left").withColumns(changed).select(*records.columns)


def deduplicate(spark: SparkSession, source: str, target: str, least_bytes: int = 0, compression: str | None = "gzip") -> str:
    """Write the archive ``source`` to ``target`` with one response for equal payloads.

    Every record gets fresh fields: type, lengths, digest, date and reference. A damaged
    record counts by the payload that it holds.
    """
    records = resolve(read_archive(spark, source), least_bytes)
    return write_archive(records.withColumn("date", _now()), target, compression)


def archive_and_resolve(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as an archive, deduplicate it, and read that back.

    A null or empty html is an empty payload, equal to any other; null and repeated
    page ids are kept, of repeated rows one is the response. An empty table gives an
    archive without a record. Other columns are not looked at. Both archives lie in the
    shared scratch folder.
    """
    spark = pages.sparkSession
    first = write_archive(records_of(pages), scratch_path(spark, "warc"))
    return read_archive(spark, deduplicate(spark, first, scratch_path(spark, "warc-resolved"), least_bytes))
