"""Files as tables, and their bytes as ranges that tasks read.

A folder is listed level by level: each level's directories are a table, and tasks list
them, so neither the driver nor one task sees all names. A file is cut into ranges of
bytes; a task opens the file, reads its range and the few bytes around it that it
needs, and no file is ever a row. Paths are resolved by Arrow's file systems: mounted
folders, and the object stores that Arrow was built with.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claravoz.scratch import scratch_path

#: Bytes of a range.
RANGE_BYTES = 8 * 1024 * 1024
#: Names that a scan leaves out, as Spark does.
_HIDDEN = ("_", ".")
_FILES = "path string, length long, is_dir boolean"


@lru_cache(maxsize=64)
def file_system(scheme: str, host: str):
    """Arrow's file system for a scheme and host; none is the local one."""
    from pyarrow import fs

    if scheme in ("", "file"):
        return fs.LocalFileSystem()
    return fs.FileSystem.from_uri(f"{scheme}://{host}/")[0]


def split_uri(path: str) -> tuple[str, str, str]:
    """(scheme, host, path within) of a URI or a plain path."""
    found = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]+):)?(?://([^/]*))?(.*)\Z", path, re.S)
    scheme, host, inner = found[1] or "", found[2] or "", found[3]
    return scheme, host, "/" + inner.lstrip("/") if scheme in ("", "file") and (scheme or inner.startswith("/")) else inner


class Source:
    """One open file of which ranges are read."""

    def __init__(self, path: str):
        scheme, host, inner = split_uri(path)
        name = inner if scheme in ("", "file") else f"{host}{inner}"
        self.file = file_system(scheme, host).open_input_file(name)
        self.size = self.file.size()

    def __enter__(self) -> Source:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def read(self, start: int, end: int) -> bytes:
        """The bytes from ``start`` to before ``end``, as far as the file has them."""
        start, end = max(start, 0), min(end, self.size)
        return self.file.read_at(end - start, start) if end > start else b""


def glob_pattern(path: str) -> tuple[str, str]:
    """(folder without wildcards, pattern that a listed path or one above it must match).

    ``*`` and ``?`` stay within a name; ``[..]`` and ``{a,b}`` are alternatives.
    """
    wild = re.search(r"[*?\[{]", path)
    if not wild:
        return path, ""
    base = path[:wild.start()].rpartition("/")[0]
    pattern, depth = "", 0
    for c in path:
        if c == "*":
            pattern += "[^/]*"
        elif c == "?":
            pattern += "[^/]"
        elif c == "{":
            pattern, depth = pattern + "(?:", depth + 1
        elif c == "}" and depth:
            pattern, depth = pattern + ")", depth - 1
        elif c == "," and depth:
            pattern += "|"
        elif c in "[]":
            pattern += c
        else:
            pattern += re.escape(c)
    scheme, _, _ = split_uri(path)
    return base or "/", ("" if scheme else "(?:file:)?") + pattern + "(?:/.*)?"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is in each folder of ``path``; a path that is a file is itself."""
    from pyarrow import fs

    for batch in batches:
        for path in batch.column("path").to_pylist():
            scheme, host, inner = split_uri(path)
            system, local = file_system(scheme, host), scheme in ("", "file")
            name = inner if local else f"{host}{inner}"
            head = "file:" if local else f"{scheme}://"
            top = system.get_file_info(name)
            if top.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            infos = [top] if top.is_file else system.get_file_info(fs.FileSelector(name))
            for start in range(0, len(infos), 10_000):
                part = [i for i in infos[start:start + 10_000] if i.type != fs.FileType.NotFound]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([head + i.path for i in part], pa.string()), pa.array([i.size or 0 if i.is_file else 0 for i in part], pa.int64()),
                     pa.array([not i.is_file for i in part], pa.bool_())], names=["path", "length", "is_dir"])


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of every file below ``path``, a folder, a file, or a pattern.

    Names that begin with ``_`` or a dot are left out, with what is below them. Each
    level of folders is one job; its folders are dealt over tasks, and its names are
    written to the scratch folder, so a lost task lists again only its own folders.
    A path that is not there is an error.
    """
    base, pattern = glob_pattern(path.rstrip("/") or "/")
    level = spark.createDataFrame([(base,)], "path string")
    shown = ~F.substring(F.element_at(F.split("path", "/"), -1), 1, 1).isin(*_HIDDEN)
    levels: list[str] = []
    while True:
        folder = scratch_path(spark, "listing")
        found = level.mapInArrow(_listed, _FILES)
        (found.where(shown) if levels else found.where(shown | (F.col("path") == _spelled(base)))).write.parquet(folder)
        levels.append(folder)
        listed = spark.read.schema(_FILES).parquet(folder)
        folders = listed.where("is_dir").count()
        if not folders:
            break
        # a given number keeps adaptive execution from listing all folders in one task
        level = listed.where("is_dir").select("path").repartition(task_count(spark, folders), "path")
    every = spark.read.schema(_FILES).parquet(*levels).where("NOT is_dir").select("path", "length")
    return every.where(F.col("path").rlike(f"^{pattern}$")) if pattern else every


def _spelled(path: str) -> str:
    """A path as the listing writes it."""
    scheme, host, inner = split_uri(path)
    return f"file:{inner}" if scheme in ("", "file") else f"{scheme}://{host}{inner}"


def task_count(spark: SparkSession, items: int) -> int:
    """Tasks for so many ranges or folders: some for each core, and no more than 64 items each."""
    return max(1, min(items, max(4 * spark.sparkContext.defaultParallelism, items // 64)))


def cut(files: DataFrame, size: int = RANGE_BYTES) -> tuple[DataFrame, int]:
    """(``files`` with ``start`` and ``stop`` of each range, tasks to read them); empty files have none."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long")))
    wanted = files.where("length > 0")
    ranges = wanted.select("*", starts.alias("start")).withColumn("stop", F.least(F.col("start") + size, F.col("length")))
    total = wanted.agg(F.coalesce(F.sum(F.ceil(F.col("length") / size)), F.lit(0))).first()[0]
    return ranges, task_count(files.sparkSession, int(total))


def read_ranges(ranges: DataFrame, tasks: int, rows: Callable[[Source, dict], Iterator[dict]], schema: str, fields: pa.Schema) -> DataFrame:
    """The rows that ``rows`` makes of each range: it gets the open file and the range's columns.

    Ranges are dealt evenly over ``tasks``, whatever files they are of; a row of a range is
    small, so without a number adaptive execution would read all of them in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.to_pylist():
                with Source(item["path"]) as source:
                    held, size = [], 0
                    for row in rows(source, item):
                        held.append(row)
                        size += len(row.get("record") or "")
                        if len(held) >= 10_000 or size >= 4_000_000:
                            yield pa.RecordBatch.from_pylist(held, fields)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, fields)

    return ranges.repartition(tasks, "path", "start").mapInArrow(run, schema)


# --- encodings --------------------------------------------------------------------------

#: Bytes that stand for nothing in Windows-1252.
UNDEFINED = bytes((0x81, 0x8D, 0x8F, 0x90, 0x9D))
WIDE = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}
UTF8_MARK = b"\xef\xbb\xbf"


def wide_encoding(source: Source) -> str | None:
    """The UTF-16 form that a file's mark names."""
    return WIDE.get(source.read(0, 2))


def valid_utf8(source: Source, start: int, stop: int, data: bytes) -> bool:
    """Whether the characters that begin in a range are valid UTF-8. Three bytes on either
    side tell which bytes at its edges belong to a character of a neighbour."""
    before = source.read(start - 3, start)
    open_bytes = 0  # of a character that began before the range
    for back in range(1, len(before) + 1):
        byte = before[-back]
        if byte & 0xC0 == 0x80:
            continue
        size = 2 if byte >> 5 == 6 else 3 if byte >> 4 == 14 else 4 if byte >> 3 == 30 else 1
        open_bytes = max(0, size - back)
        break
    lead = min(open_bytes, len(data))
    tail = source.read(stop, stop + 3)
    whole = data[lead:]
    last = next((k for k in range(1, min(4, len(whole) + 1)) if whole[-k] & 0xC0 != 0x80), 0)
    if last:
        byte = whole[-last]
        size = 2 if byte >> 5 == 6 else 3 if byte >> 4 == 14 else 4 if byte >> 3 == 30 else 1
        whole += tail[:max(0, size - last)]
    try:
        whole.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True
