import json
import os
import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from claravoz.catalog import QUERIES
from claravoz.plans import jobs
from claravoz.sources import csv_ranges, inventory, json_ranges, ranges, readers

CSV_PARTS = ["a", "b", ",", '"', "\n", "\r\n", "\r", "a,", '"a"', ',"b\nc"', '""', "é"]


def records_of(text):
    """Records of a CSV text, character by character; blank ones left out."""
    out, state, now, i = [], "start", "", 0
    while i < len(text):
        c = text[i]
        if c in "\r\n" and state != "quoted":
            out.append(now)
            now, state = "", "start"
            i += 2 if text[i:i + 2] == "\r\n" else 1
            continue
        if state == "quoted":
            state = "behind" if c == '"' else state
        elif state == "behind":
            state = "quoted" if c == '"' else "start" if c == "," else "bare"
        else:
            state = "quoted" if c == '"' and state == "start" else "start" if c == "," else "bare"
        now += c
        i += 1
    return [r for r in [*out, now] if r]


@pytest.mark.parametrize("code", ["utf-8", "utf-8-sig", "utf-16"])
def test_csv_records_by_ranges(tmp_path, code):
    """Any cut into ranges gives the records of the whole text, with the states that ranges report."""
    rnd = random.Random(code)
    path = str(tmp_path / "x.csv")
    for _ in range(600):
        text = "".join(rnd.choice(CSV_PARTS) for _ in range(rnd.randint(1, 25)))
        with open(path, "w", newline="", encoding=code) as file:
            file.write(text)
        size, entry, got, lengths = rnd.choice([4, 6, 16]), 0, [], []
        with ranges.Source(path) as source:
            wide = ranges.wide_encoding(source)
            for start in range(0, source.size, size):
                stop = min(start + size, source.size)
                found = list(csv_ranges._records(source, start, stop, ",", entry, wide))
                assert [o for o, _ in found] == sorted({o for o, _ in found}) and all(start <= o < stop for o, _ in found)
                got += [r.decode() for _, r in found]
                shape = csv_ranges.shapes(source, start, stop, wide)[0]["inside" if entry else "outside"]
                lengths.append(shape)
                entry = shape["exit"]
        assert got == records_of(text), repr(text)
        counts = sum(r["n"] for s in lengths for r in s["rows"])
        assert counts <= len(got)


def random_json(rnd, depth=0):
    if depth > 3 or rnd.random() < 0.4:
        return rnd.choice(["1", '"a"', '"x\\"y,"', '"\\\\"', "true", '"]"', "-2.5", '"é"'])
    space = lambda: rnd.choice(["", "", " ", "\n"])
    if rnd.random() < 0.5:
        return "[" + ",".join(space() + random_json(rnd, depth + 1) + space() for _ in range(rnd.randint(0, 4))) + "]"
    return "{" + ",".join(f'{space()}"k{i}"{space()}:{random_json(rnd, depth + 1)}{space()}' for i in range(rnd.randint(0, 4))) + "}"


def parses(text):
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


BREAKS = ["{", "}", "[", "]", ",", ":", '"a"', "1", " ", "\n", '"b":[1]', '{"a":1}', '"', "\\", ""]


@pytest.fixture(scope="module")
def json_files(tmp_path_factory):
    """Documents, documents a line, and broken ones."""
    rnd, folder, texts = random.Random(8), tmp_path_factory.mktemp("json"), {}
    for k in range(500):
        text = random_json(rnd)
        if rnd.random() < 0.5:
            i = rnd.randrange(len(text) + 1)
            text = text[:i] + rnd.choice(BREAKS) + text[min(len(text), i + rnd.randint(0, 2)):]
        if rnd.random() < 0.2:
            text = "\n".join(random_json(rnd, 2) for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "\n"])
        text = f" \n{text}\n" if rnd.random() < 0.2 else text
        texts[f"{k}.json"] = text
        (folder / f"{k}.json").write_bytes(text.encode(rnd.choice(["utf-8", "utf-8", "utf-8-sig", "utf-16"])))
    return str(folder), texts


def test_json_files_agree_with_a_parser(spark, json_files):
    folder, texts = json_files
    found = {os.path.basename(r["path"]): r for r in inventory.profile_files(spark, folder, range_bytes=10).collect()}
    valid = 0
    for name, text in texts.items():
        if not text:
            continue
        lines = [x for x in text.split("\n") if x.strip(" \t\r")]
        whole, each = parses(text), bool(lines) and all(map(parses, lines))
        assert found[name]["passed"] == (whole or each), repr(text)
        valid += whole
        if whole:
            document = json.loads(text)
            assert found[name]["rows"] == (len(document) if isinstance(document, list) else 0), repr(text)
    assert 100 < valid < 450


def test_multi_line_csv_equals_the_one_task_reader(spark, tmp_path):
    """Random quoting, malformed fields included, parsed by Spark from ranges and from whole files."""
    rnd = random.Random(4)
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(4):
        rows = ["".join(rnd.choice(["a", "é", ",", '"', "\n", '"a"', ',"b\nc"', '""', ",x", "\n"]) for _ in range(30)) for _ in range(120)]
        text = "one,two,three\n" + "\n".join(rows) + '\n'
        (folder / f"{k}.csv").write_bytes(text.encode())
    options = {**readers.CSV_OPTIONS, "columnNameOfCorruptRecord": readers.CORRUPT}
    schema = readers.text_schema(["one", "two", "three"])
    for path in sorted(folder.iterdir()):
        want = [tuple(r) for r in spark.read.schema(schema).options(**options).csv(str(path)).collect()]
        found = inventory.profile(spark, str(path), range_bytes=100, delimiter=",")
        scan = readers.csv_scans(found)[0]
        got = [tuple(r) for r in scan.collect()]
        cells = lambda rows: sorted(map(str, (r[:3] for r in rows)))
        assert cells(got) == cells(want)
        if path.name in ("0.csv", "1.csv"):
            assert csv_ranges.records(found.csv_ranges, found.tasks).groupBy("path").count().first()["count"] == len(want) + 1


ODD_TEXTS = [None, "", " ", "  before", "behind \n", "\n\tx", "a\r\nb", "a\rb", "\r", '"', '"a"', 'a"', '"\n', '\n",1,"', "a\\", '\\"', ",", "a\x00b", '"\x00"', "\x0b",
             "\ufeffx", "null", "NaN", "#", "\x85", "\u2028", "é" * 40_000, 'q"\x00\r\n, ' * 9_000]


@pytest.mark.parametrize("name", ["csv_range_scan", "raw_csv_multiline"])
def test_texts_written_as_csv_come_back_as_they_were(spark, tmp_path, name):
    want = [(str(i), [None, "", " en ", '"', "\r"][i % 5], text) for i, text in enumerate(ODD_TEXTS)]
    spark.createDataFrame(want, "doc_id string, lang string, text string").withColumn("doc_id", F.col("doc_id").cast("long")) \
        .write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES[name](spark, str(tmp_path)).select("doc_id", "lang", "text").collect()
    assert sorted(map(tuple, got), key=lambda r: int(r[0])) == want


def test_profile_of_odd_files(spark, tmp_path):
    folder = tmp_path / "odd"
    folder.mkdir()
    texts = {
        "multi.csv": 'a,b\n"x\ny",2\n' * 50, "crlf.csv": "a;b\r\n1;2\r\n\r\n3;4\r\n", "inch.csv": 'size,name\n5" pipe,x\n6" pipe,y\n', "open.csv": 'a,b\n1,"2\n3,4\n',
        "blank.csv": "\n\n\n", "tab.txt": "a\tb\tc\n" * 9, "old.csv": "a,b\r1,2\r3,4\r", "wide.csv": None, "latin.csv": None, "ansi.csv": None, "noise.csv": None,
    }
    raw = {"wide.csv": ("a,b\nñ,😀\n" * 20).encode("utf-16"), "latin.csv": ("a,b\nseñor,1\n" * 9).encode("latin-1"),
           "ansi.csv": ("a,b\n“señor”,1\n" * 9).encode("cp1252"), "noise.csv": b"a,b\n\x81\xff,1\n"}
    for name, text in texts.items():
        (folder / name).write_bytes(raw.get(name) or text.encode())
    for size in (16, 1 << 24):
        found = {os.path.basename(r["path"]): r for r in inventory.profile_files(spark, str(folder), single_byte=True, range_bytes=size).collect()}
        facts = {name: (r["delimiter"], r["rows"], r["uneven_rows"], r["multi_line"], r["encoding"], r["errors"]) for name, r in found.items()}
        assert facts["multi.csv"] == (",", 100, 0, True, "utf-8", [])
        assert facts["crlf.csv"] == (";", 3, 0, False, "utf-8", [])
        assert facts["inch.csv"] == (",", 3, 0, False, "utf-8", [])
        assert facts["open.csv"] == (",", 2, 0, True, "utf-8", ["quote is not closed"])
        assert facts["blank.csv"][1] == 0 and "insufficient rows" in facts["blank.csv"][5]
        assert facts["tab.txt"] == ("\t", 9, 0, False, "utf-8", [])
        assert facts["old.csv"] == (",", 3, 0, False, "utf-8", [])
        assert facts["wide.csv"] == (",", 40, 0, False, "utf-16", [])
        assert facts["latin.csv"] == (",", 18, 0, False, "iso-8859-1", []) and facts["ansi.csv"][4] == "windows-1252"
        assert facts["noise.csv"][5] == ["not valid UTF-8"] and found["multi.csv"]["header"] == ["a", "b"]


def test_utf8_at_range_edges(tmp_path):
    rnd = random.Random(2)
    path = str(tmp_path / "x")
    for _ in range(600):
        data = bytearray("".join(rnd.choice(["a", "é", "語", "😀"]) for _ in range(rnd.randint(1, 20))).encode())
        for _ in range(rnd.randint(0, 1)):
            data[rnd.randrange(len(data))] = rnd.choice([0x80, 0xC3, 0xE8, 0xF0, 0x41, 0xFF])
        with open(path, "wb") as file:
            file.write(data)
        try:
            bytes(data).decode()
            want = True
        except UnicodeDecodeError:
            want = False
        size = rnd.choice([1, 2, 3, 5, 9])
        with ranges.Source(path) as source:
            got = all(ranges.valid_utf8(source, a, min(a + size, len(data)), source.read(a, a + size)) for a in range(0, len(data), size))
        assert got == want, bytes(data)


def test_listing(spark, tmp_path):
    """Nested and empty folders, hidden and empty files, patterns, a single file, a missing path."""
    for name, text in {"a.csv": "x", "b/c.csv": "", "b/d/e f+%.json": "12", "_tmp/x.csv": "x", "b/.hidden": "x", "g/h.txt": "1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "empty").mkdir()

    def names(path):
        return {r["path"].removeprefix(f"file:{tmp_path}/"): r["length"] for r in ranges.list_files(spark, path).collect()}

    every = {"a.csv": 1, "b/c.csv": 0, "b/d/e f+%.json": 2, "g/h.txt": 1}
    assert names(str(tmp_path)) == names(f"file://{tmp_path}/") == every
    assert names(f"{tmp_path}/*.csv") == {"a.csv": 1} and names(f"{tmp_path}/{{b,g}}/*") == {k: v for k, v in every.items() if "/" in k}
    assert names(f"{tmp_path}/a.csv") == {"a.csv": 1} and names(f"{tmp_path}/empty") == {}
    with pytest.raises(Exception, match="FileNotFound"):
        ranges.list_files(spark, f"{tmp_path}/nothing")


def test_many_small_files(spark, tmp_path):
    for k in range(100):
        (tmp_path / f"d{k}").mkdir()
        for i in range(1000):
            os.close(os.open(tmp_path / f"d{k}" / f"f{i}.csv", os.O_CREAT))
    found = ranges.list_files(spark, str(tmp_path))
    assert found.count() == 100_000
    assert found.rdd.getNumPartitions() > 1


def test_ingest_of_large_records_and_encodings(spark, tmp_path, monkeypatch):
    """Quoted line breaks, records over several ranges, Latin-1, and a JSON list on one line."""
    monkeypatch.setattr(inventory, "profile", partial(inventory.profile, range_bytes=64))
    folder = tmp_path / "in"
    folder.mkdir()
    long = "line\n" * 100
    (folder / "a.csv").write_text("user,note\n" + "".join(f'u{i},"{long}{i}"\n' for i in range(30)))
    (folder / "b.csv").write_bytes("note;user\nseñor;v1\nx;v2;extra\n".encode("latin-1"))
    out = jobs.ingest(spark, f"{folder}/*.csv", str(tmp_path / "o"), str(tmp_path / "h"), canonical={"unused": ["unused"]})
    rows = {r["user"]: r["note"] for r in out.good(spark).collect()}
    assert (out.rows, out.malformed) == (31, 1) and rows["v1"] == "señor" and rows["u7"] == long + "7"
    (tmp_path / "l.json").write_text("[" + ",".join(json.dumps({"a": i, "b": {"c": "x,]" * 30}}) for i in range(40)) + "]")
    (tmp_path / "m.json").write_text('{\n "a": 1,\n "d": "one"\n}')
    out = jobs.ingest(spark, f"{tmp_path}/*.json", str(tmp_path / "o2"), str(tmp_path / "h2"), fmt="json", canonical={"unused": ["unused"]})
    rows = [(r["a"], r["b"], r["d"]) for r in out.good(spark).collect()]
    assert len(rows) == 41 and ("1", None, "one") in rows and ("39", '{"c":"' + "x,]" * 30 + '"}', None) in rows


def test_values_of_a_document(spark, tmp_path):
    (tmp_path / "x.json").write_text(' [1, {"a": "]"}, [2, 3]]\n')
    found = inventory.profile(spark, str(tmp_path), range_bytes=4)
    got = [r["record"].strip() for r in json_ranges.values(found.json_ranges, found.tasks).orderBy("start", "number").collect()]
    assert got == ["1", '{"a": "]"}', "[2, 3]"]
    assert inventory.profile(spark, str(tmp_path)).files.where(F.col("rows") == 3).count() == 1
