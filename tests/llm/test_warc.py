import base64
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claravoz.llm import queries, warc
from claravoz.scratch import scratch_path
from tests.llm.conftest import CLASHING

SCHEMA = "page_id long, url string, html string"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def resolved(rows, least=0):
    """Brute force: (page_id, bytes, digest, type, refers_to) of each row."""
    order = lambda p: (p is None, p or 0)
    out, seen = [], set()
    for page, _, html in sorted(rows, key=lambda r: order(r[0])):
        data = (html or "").encode()
        first = min((r[0] for r in rows if (r[2] or "").encode() == data), key=order)
        again = data in seen and len(data) >= least
        seen.add(data)
        out.append((page, len(data), digest(data), "revisit" if again else "response", first if again else None))
    return Counter(out)


@pytest.fixture(scope="module")
def odd_pages():
    record = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    return [(1, "http://a/", "<p>é😀</p>"), (2, "http://b/", "<p>é😀</p>"), (0, None, "<p>é😀</p>"), (3, "u", None), (4, "u", ""), (None, "u", "z"),
            (None, None, None), (5, "u\r\nX: y", "a\r\n\r\nb"), (6, "ü", record * 3), (7, "", record * 3), (8, "v", "\r\n\r\n"), (9, "v", "\n"),
            (10, "v", "x" * 300_000), (10, "v", "x" * 300_000), (11, "v", "\0\r\n"), (-5, "v", "\0\r\n"), (12, "v", "x\r\n" * 50_000), (13, "v", "z")]


@pytest.fixture(scope="module")
def pages(spark, odd_pages):
    docs = spark.createDataFrame(odd_pages, SCHEMA)
    extra = [x.split() for x in (CLASHING + ", record_id string, payload binary, date string, record_type string").split(", ")]
    return docs.select("*", *(F.lit(None).cast(t).alias(c) for c, t in extra)).repartition(3)


def rows_of(found):
    return Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect())


@pytest.mark.parametrize("least", [0, 2, 10 ** 9])
def test_pages(pages, odd_pages, least):
    found = warc.archive_and_resolve(pages, least)
    assert rows_of(found) == resolved(odd_pages, least)
    assert found.where("damaged").count() == 0


def test_empty_table(spark):
    assert warc.archive_and_resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_payloads_come_back(spark, pages, odd_pages):
    """Whole and unchanged, from split files and from gzip; a revisit has none."""
    for compression in (None, "gzip"):
        path = warc.write_archive(warc.records_of(pages), scratch_path(spark, "test"), compression)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
        try:
            found = warc.read_archive(spark, path)
            assert compression or found.rdd.getNumPartitions() > 10
            got = Counter((r["page_id"], bytes(r["payload"])) for r in found.collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == Counter((p, (h or "").encode()) for p, _, h in odd_pages)
    last = warc.read_archive(spark, warc.deduplicate(spark, path, scratch_path(spark, "test")))
    assert {r["payload"] for r in last.where("record_type = 'revisit'").collect()} == {None}
    uris = {r["page_id"]: r["uri"] for r in last.collect()}
    assert (uris[5], uris[6], uris[0]) == ("u X: y", "ü", None)


def test_file_is_an_archive(spark, pages):
    """Read by a small parser: version, fields, Content-Length bytes, two line ends, again."""
    path = warc.write_archive(warc.records_of(pages.where("page_id < 9").coalesce(1)), scratch_path(spark, "test"), None)
    found = warc.deduplicate(spark, path, scratch_path(spark, "test"), compression=None)
    data = b"".join(bytes(r["content"]) for r in spark.read.format("binaryFile").load(f"{found}/*.txt").collect())
    kinds, ids, refers = [], set(), set()
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        block, data = data[:int(fields["Content-Length"])], data[int(fields["Content-Length"]):]
        assert version == "WARC/1.1" and data[:4] == b"\r\n\r\n"
        data = data[4:]
        http, _, payload = block.partition(b"\r\n\r\n")
        kinds.append(fields["WARC-Type"])
        ids.add(fields["WARC-Record-ID"])
        if kinds[-1] == "revisit":
            refers.add(fields["WARC-Refers-To"])
            assert payload == b"" and fields["WARC-Profile"] == warc.PROFILE
        else:
            assert fields["WARC-Payload-Digest"] == "sha1:" + digest(payload) and f"Content-Length: {len(payload)}".encode() in http
    assert len(ids) == len(kinds) == 10 and kinds.count("revisit") == 4 and refers <= ids


def test_foreign_archive_with_revisits(spark, tmp_path):
    def record(kind, name, payload, size=None, more="", length=None):
        http = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n"
        block = http + ("" if kind == "revisit" else payload)
        n = len(block.encode()) if length is None else length
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\n"
                f"WARC-Payload-Digest: sha1:{digest(payload.encode())}\r\n{more}content-length: {n}\r\n\r\n{block}\r\n\r\n")

    text = ("WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab\r\n\r\n" + record("response", "b", "one") + record("revisit", "a", "one", 3)
            + record("response", "c", "one") + record("revisit", "d", "gone", 4, "WARC-Refers-To: <urn:uuid:x>\r\n") + record("response", "e", "two", length=99))
    (tmp_path / "a.warc").write_bytes(text.encode())
    found = warc.read_archive(spark, str(tmp_path))
    assert {r["record_id"][9:]: r["damaged"] for r in found.collect()} == {"a": False, "b": False, "c": False, "d": False, "e": True}
    last = warc.read_archive(spark, warc.deduplicate(spark, str(tmp_path), scratch_path(spark, "test")))
    got = {r["record_id"][9:]: (r["record_type"], (r["refers_to_record"] or "")[9:], r["payload_bytes"], r["payload"] and bytes(r["payload"])) for r in last.collect()}
    assert got["b"] == ("response", "", 3, b"one") and got["a"] == got["c"] == ("revisit", "b", 3, None)
    assert got["d"] == ("revisit", "x", 4, None) and got["e"][0] == "response"


def test_not_an_archive(spark, tmp_path):
    (tmp_path / "x.txt").write_text("hello\r\n")
    with pytest.raises(ValueError):
        warc.read_archive(spark, str(tmp_path))


def test_one_digest_of_many_records(spark):
    rnd = random.Random(3)
    rows = [(i, "u", "same" if rnd.random() < 0.5 else f"p{rnd.randint(0, 40)}") for i in rnd.sample(range(1000), 300)]
    assert rows_of(warc.archive_and_resolve(spark.createDataFrame(rows, SCHEMA).repartition(4))) == resolved(rows)


def test_query_and_sql(spark, sf):
    from tests.oracle import compare, connect
    name = "op13_warc"
    assert compare(spark, connect(sf), sf, queries.QUERIES[name], queries.ORACLES[name]) is None
