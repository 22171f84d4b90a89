"""JSON files by ranges of bytes: strings, depth, and the values at the top.

Brackets count only outside strings, and a range cannot know whether it begins in one. It
reports both readings: whether it ends in a string, by how much the depth of brackets
changes, and how deep its line ends lie. In order, these give each range its true state
and depth. A second pass cuts a document at its separators of depth one, or a file of
one document a line at its line ends; each value goes to Spark's own parser, so a
document is never a row. A range owns the values that begin in it and reads on to the end of
its last one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claravoz.sources.ranges import UTF8_MARK, Source, read_ranges, wide_encoding

QUOTE, BACKSLASH, COMMA, LF = 0x22, 0x5C, 0x2C, 0x0A
#: Change of depth by byte.
_STEP = np.zeros(256, np.int8)
_STEP[[0x5B, 0x7B]], _STEP[[0x5D, 0x7D]] = 1, -1
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
#: Bytes that a task reads at a time to find the end of a value that leaves its range.
AHEAD = 1 << 16


class Text:
    """Bytes of a range, with the backslashes and the byte right before it. ``lo`` to ``hi`` is the range."""

    def __init__(self, source: Source, start: int, stop: int, wide: str | None):
        unit, slash = (2, "\\".encode(wide)) if wide else (1, b"\\")
        inside, before, at = source.read(start, stop), b"", start
        while at > 0:
            more = source.read(at - 64 * unit, at)
            before, at = more + before, at - len(more)
            if before.replace(slash, b""):
                break
        if wide:
            before, inside = before.decode(wide, "replace").encode(), inside.decode(wide, "replace").encode()
        if start == 0 and inside.startswith(UTF8_MARK):
            before, inside = inside[:3], inside[3:]
        self.bytes = np.frombuffer(before + inside, np.uint8)
        self.lo, self.hi = len(before), len(before) + len(inside)


def quotes_of(text: np.ndarray, lo: int) -> np.ndarray:
    """Places of the quotes from ``lo`` on that no backslash escapes."""
    places = np.flatnonzero(text[lo:] == QUOTE) + lo
    slashes = np.flatnonzero(text == BACKSLASH)
    if not len(slashes) or not len(places):
        return places
    begins = slashes[np.r_[True, np.diff(slashes) > 1]]
    behind = (places > 0) & (text[np.maximum(places - 1, 0)] == BACKSLASH)
    size = places - begins[np.maximum(np.searchsorted(begins, places) - 1, 0)]
    return places[~(behind & (size % 2 == 1))]


class Reading:
    """What lies outside strings in a text that begins inside one (``entry`` 1) or not."""

    def __init__(self, text: np.ndarray, lo: int, entry: int, quotes: np.ndarray):
        self.quotes, self.entry = quotes, entry
        brackets = np.flatnonzero(_STEP[text[lo:]]) + lo
        self.brackets = brackets[self.outside(brackets)]
        self.step = _STEP[text[self.brackets]].astype(np.int64)
        self.depth = np.cumsum(self.step)  # behind each bracket, from 0

    def outside(self, places: np.ndarray) -> np.ndarray:
        return (np.searchsorted(self.quotes, places) + self.entry) % 2 == 0

    def depth_at(self, places: np.ndarray) -> np.ndarray:
        """Depth before each place."""
        return np.append(0, self.depth)[np.searchsorted(self.brackets, places)]


_SIDE = pa.struct([("exit", pa.int32()), ("net", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("inside", pa.bool_())])
SUMMARY = pa.struct([("outside", _SIDE), ("inside", _SIDE), ("first", pa.int64()), ("last", pa.int64()), ("line", pa.int64()), ("line_after", pa.int64()),
                     ("opening", pa.string())])
_SIDE_DDL = "struct<exit: int, net: long, low: long, high: long, inside: boolean>"
SUMMARY_DDL = f"struct<outside: {_SIDE_DDL}, inside: {_SIDE_DDL}, first: long, last: long, line: long, line_after: long, opening: string>"


def _content_ends(text: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The first and the last place of a range that is not blank; none of a blank range."""
    filled = ~_BLANK[text[lo:hi]]
    if not filled.any():
        return np.zeros(0, np.int64)
    return np.array([lo + int(filled.argmax()), hi - 1 - int(filled[::-1].argmax())], np.int64)


def summary(source: Source, start: int, stop: int, wide: str | None) -> dict:
    """Both readings of a range, where its content begins and ends, and its first line ends.

    Places are counted from the range's start.
    """
    part = Text(source, start, stop, wide)
    text, lo, hi = part.bytes, part.lo, part.hi
    content, lines = _content_ends(text, lo, hi), np.flatnonzero(text[lo:hi] == LF) + lo
    quotes = quotes_of(text, lo)
    after = lines[np.searchsorted(lines, content[0]):] if len(content) else lines[:0]
    at = lambda found, k: int(found[k]) - lo if len(found) else None
    out = {"first": at(content, 0), "last": at(content, -1), "line": at(lines, 0), "line_after": at(after, 0),
           "opening": chr(text[content[0]]) if len(content) and text[content[0]] < 128 else None}
    for name, entry in (("outside", 0), ("inside", 1)):
        own = Reading(text, lo, entry, quotes)
        open_lines = own.outside(lines)
        deep = own.depth_at(lines[open_lines])
        out[name] = {"exit": (len(quotes) + entry) % 2, "net": int(own.depth[-1]) if len(own.depth) else 0,
                     "low": int(deep.min()) if len(deep) else None, "high": int(deep.max()) if len(deep) else None, "inside": bool((~open_lines).any())}
    return out


def layouts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, files): the state at the start of each range, and how each file is laid out.

    ``facts`` has path, start and ``json`` (``SUMMARY``). Entries: path, start, entry (1 in a
    string), depth. Files: path, ``lines`` (one document a line), ``head`` (start of the range in
    which the content begins), ``opening`` (its first character), ``balanced`` (no string or bracket is
    open at the end), ``several`` (content on more than one line).
    """
    order = Window.partitionBy("path").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parity = F.coalesce(F.sum("json.outside.exit").over(before), F.lit(0)) % 2
    known = facts.select("path", "start", "json").withColumn("entry", parity.cast("int")).withColumn(
        "now", F.when(F.col("entry") == 1, F.col("json.inside")).otherwise(F.col("json.outside")))
    known = known.withColumn("depth", F.coalesce(F.sum("now.net").over(before), F.lit(0)).cast("long"))
    place = lambda name: F.when(F.col(f"json.{name}").isNotNull(), F.struct("start", F.col(f"json.{name}").alias("at")))
    content = F.when(F.col("json.first").isNotNull(), F.struct("start", "json.opening"))
    ends = known.groupBy("path").agg(
        F.min(content).alias("_head"), F.max(place("last")).alias("_last"), F.sum("now.net").alias("_net"), F.max_by("now.exit", "start").alias("_exit"),
        F.bool_or("now.inside").alias("_inside"), F.min(F.col("depth") + F.col("now.low")).alias("_low"), F.max(F.col("depth") + F.col("now.high")).alias("_high"))
    # a line end between the first content and the last
    line = F.when(F.col("start") == F.col("_head.start"), place("line_after")).when(F.col("start") > F.col("_head.start"), place("line"))
    several = known.join(ends, "path").groupBy("path").agg(F.coalesce(F.bool_or(line < F.col("_last")), F.lit(False)).alias("_several"))
    flat = ~F.col("_inside") & (F.coalesce("_low", F.lit(0)) == 0) & (F.coalesce("_high", F.lit(0)) == 0)
    files = ends.join(several, "path").select(
        "path", (F.col("_several") & flat).alias("lines"), F.col("_head.start").alias("head"), F.col("_head.opening").alias("opening"),
        ((F.col("_net") == 0) & (F.col("_exit") == 0)).alias("balanced"),
        F.col("_several").alias("several"))
    return known.select("path", "start", "entry", "depth"), files


def _finished(source: Source, begun: bytes, stop: int, wide: str | None, line: bool, whole: bool) -> bytes:
    """What a value that begins outside strings has behind its range."""
    ahead = AHEAD
    while True:
        more = source.read(stop, stop + ahead)
        every = begun + (more.decode(wide, "replace").encode() if wide else more)
        text = np.frombuffer(every, np.uint8)
        if line:
            ends = np.flatnonzero(text == LF)
        else:
            own = Reading(text, 0, 0, quotes_of(text, 0))
            ends = own.brackets[own.depth == (0 if whole else -1)][:1] + int(whole)
            if not whole:
                commas = np.flatnonzero(text == COMMA)
                commas = commas[own.outside(commas)]
                ends = np.sort(np.r_[ends, commas[own.depth_at(commas) == 0][:1]])
        ends = ends[ends >= len(begun)]
        if len(ends):
            return every[len(begun):ends[0]]
        if stop + len(more) >= source.size:
            return every[len(begun):]
        ahead *= 4


def _values(source: Source, item: dict, wide: str | None) -> Iterator[tuple[int, str, bytes | None]]:
    """(number in the range, kind, bytes) of each value that begins in a range; kind ``bad`` for
    content where a document allows none."""
    start, stop, objects = item["start"], item["stop"], item["whole_objects"]
    part = Text(source, start, stop, wide)
    text, lo, hi = part.bytes, part.lo, part.hi
    data = text.tobytes()
    if item["lines"]:
        feeds = np.flatnonzero(text[lo:hi] == LF) + lo
        begins = np.r_[[lo] if start == 0 or text[lo - 1] == LF else np.zeros(0, np.int64), feeds + 1].astype(np.int64)
        begins = begins[begins < hi]
        ends = feeds[np.searchsorted(feeds, begins[0]):] if len(begins) else feeds
        for k, at in enumerate(begins.tolist()):
            value = data[at:ends[k]] if k < len(ends) else data[at:hi] + _finished(source, data[at:hi], stop, wide, True, False)
            if value.strip(b" \t\r\n"):
                yield k, "line", value.strip(b" \t\r\n")
        return
    if item["head"] is None:  # a file of blanks
        if start == 0:
            yield 0, "bad", None
        return
    first = _content_ends(text, lo, hi)[:int(item["head"] == start)]
    if item["opening"] not in ("[", "{"):
        if len(first):
            yield 0, "scalar", data[first[0]:hi] + _remainder(source, stop, wide)
        return
    own = Reading(text, lo, item["entry"], quotes_of(text, lo))
    whole = objects and item["opening"] == "{"
    depth = item["depth"]
    top = np.zeros(0, np.int64)
    if depth == 0 or (own.depth + depth == 0).any():  # few ranges have anything outside all brackets
        content = np.flatnonzero(~_BLANK[text[lo:hi]]) + lo
        top = content[(own.depth_at(content) + depth == 0) & own.outside(content)]
    closing = own.brackets[(own.depth + depth == 0) & (own.step < 0)]
    if len(top) > len(first) or (text[closing] != (0x5D if item["opening"] == "[" else 0x7D)).any():
        yield 0, "bad", None
    if whole:
        begins, ends = first, closing[:1] + 1
    else:
        commas = np.flatnonzero(text[lo:hi] == COMMA) + lo
        commas = commas[own.outside(commas)]
        commas = commas[own.depth_at(commas) + depth == 1]
        # what is right before the range opened the document or an element
        behind = start > 0 and lo > 0 and not item["entry"] and depth == 1 and text[lo - 1] in (COMMA, ord(item["opening"]))
        begins = np.r_[[lo] if behind else [], first + 1, commas + 1].astype(np.int64)
        ends = np.sort(np.r_[commas, closing])
    begins = begins[begins < hi]
    kind = "object" if whole else "element" if item["opening"] == "[" else "member"
    for k, at in enumerate(begins.tolist()):
        place = np.searchsorted(ends, at)
        value = data[at:ends[place]] if place < len(ends) else data[at:hi] + _finished(source, data[at:hi], stop, wide, False, whole)
        yield k, kind, value


def _remainder(source: Source, stop: int, wide: str | None) -> bytes:
    """All that is behind a range: a bare number, word or string is one value."""
    rest = source.read(stop, source.size)
    return rest.decode(wide, "replace").encode() if wide else rest


VALUE = "path string, start long, number long, kind string, record string"
_VALUE = pa.schema([("path", pa.string()), ("start", pa.int64()), ("number", pa.int64()), ("kind", pa.string()), ("record", pa.string())])


def values(ranges: DataFrame, tasks: int, whole_objects: bool = False) -> DataFrame:
    """(path, start, number, kind, record): the values at the top of each file, as text.

    ``ranges`` has path, start, stop, encoding, and what ``layouts`` found. Kinds: ``line``;
    ``element`` of a list; ``member`` of an object, or with ``whole_objects`` the ``object``;
    ``scalar``; ``bad``, without text, where a document has content outside its brackets or ends with
    the wrong one.
    """

    def rows(source: Source, item: dict) -> Iterator[dict]:
        wide = wide_encoding(source)
        encoding = "utf-8" if wide or item["encoding"] in ("utf-8", "utf-8-sig", "unknown") else item["encoding"]
        for number, kind, value in _values(source, item, wide):
            yield {"path": item["path"], "start": item["start"], "number": number, "kind": kind,
                   "record": None if value is None else value.decode(encoding, "replace")}

    return read_ranges(ranges.withColumn("whole_objects", F.lit(whole_objects)), tasks, rows, VALUE, _VALUE)
