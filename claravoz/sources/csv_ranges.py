"""CSV files by ranges of bytes: quotes, rows, and records for Spark's parser.

Whether a line end closes a row depends on the quotes before it, back to the start of the
file. A range cannot know, so it reports both readings: what it holds if it begins
outside quotes and if it begins inside, and in which state it ends for each. Only runs
of quotes of odd length matter. Behind a separator, a line end or the start of the file such
a run changes the state; elsewhere it closes a quoted field or is part of a bare one, so
the state behind it is outside. Such a map from state to state is a swap, the same, or
"outside"; a running sum of swaps since the last other gives each range its true state.

With it, rows and their lengths are sums over ranges, and a second pass hands every record,
cut where it truly ends, to Spark's own ``from_csv``. A range owns the records that begin in
it and reads on to the end of its last one. Blank lines are no records.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claravoz.sources.ranges import UTF8_MARK, Source, read_ranges, wide_encoding

# Separators considered, in order of preference.
DELIMITERS = (",", ";", "\t", "|")
QUOTE, LF, CR = 0x22, 0x0A, 0x0D
#: Bytes that a task reads at a time to find the end of a record that leaves its range.
AHEAD = 1 << 16
csv.field_size_limit(sys.maxsize)


@dataclass
class Piece:
    """Bytes of a range with what is before and behind it; ``lo`` to ``hi`` is the range.

    ``text`` begins with the byte before the range, if there is one. Its last quotes and
    line end are complete. UTF-16 has become UTF-8.
    """

    text: np.ndarray
    lo: int
    hi: int
    first: bool


def piece_of(source: Source, start: int, stop: int, wide: str | None = None) -> Piece:
    """The range of a file, read with its surroundings."""
    unit = 2 if wide else 1
    before = source.read(start - unit, start)
    inside, behind, at = source.read(start, stop), b"", stop
    while at < source.size:  # a run of quotes, and the byte behind it
        more = source.read(at, at + 64 * unit)
        behind, at = behind + more, at + len(more)
        if (behind.decode(wide, "replace") if wide else behind.decode("latin-1")).lstrip('"'):
            break
    if wide:
        before, inside, behind = (part.decode(wide, "replace").encode() for part in (before, inside, behind))
        before = before[-1:]
    skip = 0
    if start == 0:
        skip = len(UTF8_MARK) if inside.startswith(UTF8_MARK) else 0  # the mark of UTF-16 is the same character
    text = np.frombuffer(before + inside[skip:] + behind, np.uint8)
    return Piece(text, len(before), len(before) + len(inside) - skip, start == 0)


@dataclass
class Quotes:
    """Odd runs of quotes of a piece: where they begin, and which change the state."""

    at: np.ndarray
    swaps: np.ndarray

    def after(self, entry: int) -> np.ndarray:
        """The state (1 inside quotes) behind each run."""
        total = np.cumsum(self.swaps)
        last = np.maximum.accumulate(np.where(self.swaps, -1, np.arange(len(total))))
        return np.where(last >= 0, total - total[np.maximum(last, 0)], total + entry) % 2

    def state(self, places: np.ndarray, entry: int) -> np.ndarray:
        """The state at each place."""
        known = np.append(entry, self.after(entry))
        return known[np.searchsorted(self.at, places)]


def quotes_of(piece: Piece, delimiter: int) -> Quotes:
    """A run belongs to the range that it begins in."""
    places = np.flatnonzero(piece.text[piece.lo:] == QUOTE) + piece.lo
    if not len(places):
        return Quotes(places, places.astype(bool))
    new = np.r_[piece.lo == 0 or piece.text[piece.lo - 1] != QUOTE or places[0] != piece.lo, np.diff(places) > 1]
    begins = np.flatnonzero(new)
    sizes = np.diff(np.append(begins, len(places)))
    at = places[begins]
    odd = (sizes % 2 == 1) & (at < piece.hi)
    at = at[odd]
    before = piece.text[np.maximum(at - 1, 0)]
    fresh = (before == delimiter) | (before == LF) | (before == CR)
    if piece.first:
        fresh |= at == 0
    return Quotes(at, fresh)


def line_ends(piece: Piece) -> tuple[np.ndarray, np.ndarray, int]:
    """(where each line end begins, where it is over, first byte of the range that is none of the one before)."""
    text, lo, hi = piece.text, piece.lo, piece.hi
    feeds = np.flatnonzero(text[lo:hi] == LF) + lo
    returns = np.flatnonzero(text[lo:hi] == CR) + lo
    paired = feeds[(feeds > 0) & (text[np.maximum(feeds - 1, 0)] == CR)]
    begins = np.sort(np.concatenate([np.setdiff1d(feeds, paired, True), returns]))
    two = (text[begins] == CR) & (text[np.minimum(begins + 1, len(text) - 1)] == LF) & (begins + 1 < len(text))
    own = lo + int(len(paired) > 0 and paired[0] == lo)
    return begins, begins + 1 + two, own


def shape(piece: Piece, delimiter: str, entry: int, ends: tuple[np.ndarray, np.ndarray, int], quotes: Quotes) -> dict:
    """What a range holds if it begins in state ``entry``."""
    begins, over, own = ends
    inside = quotes.state(begins, entry) == 1
    begins, over = begins[~inside], over[~inside]
    cuts = np.flatnonzero(piece.text[piece.lo:piece.hi] == ord(delimiter)) + piece.lo
    cuts = cuts[quotes.state(cuts, entry) == 0]
    exit_ = int(quotes.after(entry)[-1]) if len(quotes.at) else entry
    found = {"exit": exit_, "breaks": bool(inside.any()), "ended": bool(len(begins)), "head_cuts": len(cuts), "head_bytes": max(0, piece.hi - own),
             "tail_cuts": 0, "tail_bytes": 0, "rows": []}
    if len(begins):
        upto = np.searchsorted(cuts, begins)
        sizes = begins - np.r_[own, over[:-1]]
        inner = np.diff(upto)[sizes[1:] > 0]
        kinds, counts = np.unique(inner, return_counts=True)
        found |= {"head_cuts": int(upto[0]), "head_bytes": int(sizes[0]), "tail_cuts": len(cuts) - int(upto[-1]),
                  "tail_bytes": int(max(0, piece.hi - over[-1])), "rows": [{"cuts": int(k), "n": int(n)} for k, n in zip(kinds, counts)]}
    return found


def _records(source: Source, start: int, stop: int, delimiter: str, entry: int, wide: str | None) -> Iterator[tuple[int, bytes]]:
    """(offset or, in UTF-16, number from the range's start, bytes) of each record that begins in a range."""
    piece = piece_of(source, start, stop, wide)
    begins, over, own = line_ends(piece)
    quotes = quotes_of(piece, ord(delimiter))
    outside = quotes.state(begins, entry) == 0
    begins, over = begins[outside], over[outside]
    text, lo, hi = piece.text, piece.lo, piece.hi
    fresh = piece.first or entry == 0 and lo > 0 and text[lo - 1] in (LF, CR)
    starts = np.r_[[own] if fresh else np.zeros(0, np.int64), over].astype(np.int64)
    starts = starts[starts < hi]
    if not len(starts):
        return
    stops = begins if fresh else begins[1:]
    data, number = text.tobytes(), 0
    shift = start - lo + (len(UTF8_MARK) if piece.first and source.read(0, 3) == UTF8_MARK else 0)
    for k, at in enumerate(starts.tolist()):
        if k < len(stops):
            record = data[at:stops[k]]
        else:
            record = data[at:hi] + _rest(source, data[at:hi], stop, delimiter, wide)
        if record:
            yield (start + number if wide else shift + at), record
            number += 1


def _rest(source: Source, begun: bytes, stop: int, delimiter: str, wide: str | None) -> bytes:
    """What a record has behind its range. ``begun`` is outside quotes at its start."""
    ahead = AHEAD
    while True:
        more = source.read(stop, stop + ahead)
        whole = begun + (more.decode(wide, "replace").encode() if wide else more)
        last = stop + len(more) >= source.size
        text = np.frombuffer(b"\n" + whole, np.uint8)
        safe = len(text) if last else max(1, len(text.tobytes().rstrip(b'"\r')))
        piece = Piece(text, 1, safe, False)
        begins, _, _ = line_ends(piece)
        begins = begins[begins >= 1]
        ended = begins[quotes_of(piece, ord(delimiter)).state(begins, 0) == 0]
        if len(ended):
            return whole[len(begun):ended[0] - 1]
        if last:
            return whole[len(begun):]
        ahead *= 4


def header_of(source: Source, delimiter: str, wide: str | None) -> dict | None:
    """The fields of a file's first record and its offset; null of a file without one."""
    ahead = AHEAD
    while True:
        stop = min(ahead, source.size)
        found = next(_records(source, 0, stop, delimiter, 0, wide), None)
        if found is not None:
            try:
                text = found[1].decode()
            except UnicodeDecodeError:
                text = found[1].decode("cp1252", "replace")
            fields = next(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))
            return {"delimiter": delimiter, "at": found[0], "fields": [name.strip() for name in fields]}
        if stop == source.size:
            return None
        ahead *= 4


_SHAPE = pa.struct([("exit", pa.int32()), ("breaks", pa.bool_()), ("ended", pa.bool_()), ("head_cuts", pa.int64()), ("head_bytes", pa.int64()),
                    ("tail_cuts", pa.int64()), ("tail_bytes", pa.int64()), ("rows", pa.list_(pa.struct([("cuts", pa.int64()), ("n", pa.int64())])))])
SHAPES = pa.list_(pa.struct([("delimiter", pa.string()), ("outside", _SHAPE), ("inside", _SHAPE)]))
_SHAPE_DDL = ("struct<exit: int, breaks: boolean, ended: boolean, head_cuts: long, head_bytes: long, tail_cuts: long, tail_bytes: long, "
              "rows: array<struct<cuts: long, n: long>>>")
SHAPES_DDL = f"array<struct<delimiter: string, outside: {_SHAPE_DDL}, inside: {_SHAPE_DDL}>>"


def shapes(source: Source, start: int, stop: int, wide: str | None) -> list[dict]:
    """Both readings of a range, for each separator."""
    piece = piece_of(source, start, stop, wide)
    ends = line_ends(piece)
    out = []
    for d in DELIMITERS:
        quotes = quotes_of(piece, ord(d))
        out.append({"delimiter": d, "outside": shape(piece, d, 0, ends, quotes), "inside": shape(piece, d, 1, ends, quotes)})
    return out


def true_shapes(facts: DataFrame) -> DataFrame:
    """(path, start, delimiter, entry, now): the reading of each range that holds.

    ``facts`` has path, start and ``shapes`` of every range. A file's summaries are a few
    hundred bytes a range and pass through one ordered window.
    """
    each = facts.select("path", "start", F.inline("shapes")).withColumns({
        "_fixed": F.col("outside.exit") == F.col("inside.exit"), "_swap": ((F.col("outside.exit") == 1) & (F.col("inside.exit") == 0)).cast("int")})
    order = Window.partitionBy("path", "delimiter").orderBy("start")
    summed = each.withColumn("_sum", F.sum("_swap").over(order))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_fixed"), F.struct(F.col("outside.exit").alias("exit"), F.col("_sum").alias("sum"))), ignorenulls=True).over(before)
    so_far = F.col("_sum") - F.col("_swap")
    entry = (F.coalesce(F.col("_last.exit"), F.lit(0)) + so_far - F.coalesce(F.col("_last.sum"), F.lit(0))) % 2
    return summed.withColumn("_last", last).withColumn("entry", entry.cast("int")).select(
        "path", "start", "delimiter", "entry", F.when(F.col("entry") == 1, F.col("inside")).otherwise(F.col("outside")).alias("now"))


def row_lengths(known: DataFrame) -> DataFrame:
    """(path, delimiter, cuts, n): how many rows of a file have so many separators.

    A row that lies in several ranges is put together from what each has of it; rows within a
    range are counted there.
    """
    order = Window.partitionBy("path", "delimiter").orderBy("start")
    numbered = known.withColumn("_part", F.sum(F.col("now.ended").cast("int")).over(order))
    ended = F.col("now.ended")
    parts = F.array_compact(F.array(
        F.struct((F.col("_part") - ended.cast("int")).alias("part"), F.col("now.head_cuts").alias("cuts"), F.col("now.head_bytes").alias("bytes")),
        F.when(ended, F.struct(F.col("_part").alias("part"), F.col("now.tail_cuts").alias("cuts"), F.col("now.tail_bytes").alias("bytes")))))
    joined = (numbered.select("path", "delimiter", "start", F.inline(parts)).groupBy("path", "delimiter", "part")
              .agg(F.sum("cuts").alias("cuts"), F.sum("bytes").alias("_bytes")).where("_bytes > 0")
              .select("path", "delimiter", "cuts", F.lit(1).cast("long").alias("n")))
    whole = known.select("path", "delimiter", F.inline("now.rows")).select("path", "delimiter", "cuts", "n")
    return joined.unionByName(whole).groupBy("path", "delimiter", "cuts").agg(F.sum("n").alias("n"))


def chosen_delimiters(lengths: DataFrame, headers: DataFrame) -> DataFrame:
    """(path, delimiter, rows, uneven_rows, header, header_at) of each file with a row.

    The separator is the one that all rows have equally often, most often first; else the
    most frequent one; else a comma. ``headers`` has the first row by each separator; uneven
    are rows of another length.
    """
    uneven = F.when(F.col("cuts") != F.size("header") - 1, F.col("n")).otherwise(0)
    per = lengths.join(headers, ["path", "delimiter"]).groupBy("path", "delimiter").agg(
        F.sum("n").cast("int").alias("rows"), F.min("cuts").alias("_low"), F.max("cuts").alias("_high"), F.sum(uneven).cast("int").alias("uneven_rows"),
        F.first("header").alias("header"), F.first("header_at").alias("header_at"))
    found = F.struct("delimiter", "rows", "uneven_rows", "header", "header_at")
    preferred = -F.array_position(F.lit(list(DELIMITERS)), F.col("delimiter"))
    even = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.lit(0))
    # with none in any row the order decides, and a comma comes first
    return per.groupBy("path").agg(F.max_by(found, F.struct(even, "_high", preferred)).alias("_best")).select("path", "_best.*")


RECORD = "path string, offset long, record string"
_RECORD = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record", pa.string())])


def records(ranges: DataFrame, tasks: int, skip_header: bool = False) -> DataFrame:
    """(path, offset, record): every record of the given ranges as text.

    ``ranges`` has path, start, stop, delimiter, encoding and entry (1 if the range begins
    inside quotes); with ``skip_header`` also header_at, the offset of a file's first record. Offsets order the records of a file; those of UTF-16 count from the
    range's start. Bytes that the encoding does not know become replacement characters.
    """

    def rows(source: Source, item: dict) -> Iterator[dict]:
        wide = wide_encoding(source)
        encoding = "utf-8" if wide or item["encoding"] in ("utf-8", "utf-8-sig", "unknown") else item["encoding"]
        for offset, record in _records(source, item["start"], item["stop"], item["delimiter"], item["entry"], wide):
            if skip_header and offset == item["header_at"]:
                continue
            yield {"path": item["path"], "offset": offset, "record": record.decode(encoding, "replace")}

    return read_ranges(ranges, tasks, rows, RECORD, _RECORD)
