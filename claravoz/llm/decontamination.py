"""Benchmark decontamination by templates.

Tokens are letter runs and numbers. In a template, numbers, units after a number
and (in a second view) capitalised words are replaced by typed placeholders, so
a question whose names and figures were changed keeps its template. Windows of
consecutive tokens are hashed and joined with the windows of the benchmark.
A Bloom filter of fixed size, made of the benchmark's hashes, lets only windows
that may match leave the tasks; the join decides.

Windows that match in one place shift together: they have one difference between
their places in document and item. Along such a diagonal the slots must be
consistent: one benchmark value always stands for one document value of its type,
and the other way round. Then the tokens that the windows cover are counted.

A third view has the tokens as they are. It finds what was copied word for word also
where most tokens are numbers, or where other slots of the diagonal are inconsistent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claravoz.llm.byte_bpe import blocks
from claravoz.llm.tables import row_id, stored, text_key, text_of

#: Units of measure that become a placeholder after a number.
UNITS = frozenset("""
    mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres
    kilometer kilometers kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces
    ton tons ml l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours
    day days week weeks month months year years mph kph kmh hz khz mhz ghz w kw kwh mw v kv a j kj cal kcal pa kpa
    percent cent cents dollar dollars euro euros usd eur degree degrees celsius fahrenheit kb mb gb tb byte bytes
""".split())
TOKEN = re.compile(r"[0-9]+(?:[.,:][0-9]+)*|[^\W\d_]+")
WORD, NAME, NUMBER = 0, 1, 2
_UNIT = 4
_NUMBER_CODE, _UNIT_CODE, _NAME_CODE = np.uint64(0x51ED270B1), np.uint64(0x2545F4914), np.uint64(0x369DEA0F3)
_PRIME = np.uint64(0x100000001B3)
PLAIN, NAMED, VERBATIM = 0, 1, 2
_FILTER_BITS = 23
#: Bytes of text whose tokens and windows are held at once, some 150 bytes for each of text.
AT_ONCE = 1_000_000


class Vocabulary(dict):
    """Number of each token; the arrays hold its hash and kind by that number.

    A token takes some 300 bytes; with more than ``MOST`` of them all are forgotten.
    """

    MOST = 100_000

    def __init__(self):
        self.hashes, self.kinds = [], []
        self.arrays = np.zeros(0, np.uint64), np.zeros(0, np.uint8)

    def __missing__(self, token: str) -> int:
        low = token.lower()
        number = token[0].isdigit()
        name = not number and token[0].isupper() and token[1:] == low[1:] and len(token) > 1
        self.hashes.append(xxhash.xxh64_intdigest(low))
        self.kinds.append(NUMBER if number else (NAME if name else WORD) | (_UNIT if low in UNITS else 0))
        self[token] = n = len(self)
        return n

    def look_up(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.MOST:
            self.clear()
            self.__init__()
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if len(self.arrays[0]) < len(self.hashes):
            self.arrays = np.array(self.hashes, np.uint64), np.array(self.kinds, np.uint8)
        return self.arrays[0][at], self.arrays[1][at]


def template(hashes: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the tokens in both views, and where each has a placeholder.

    ``begins`` marks the first token of a text, which follows no number.
    """
    number = kinds == NUMBER
    unit = (kinds & _UNIT > 0) & np.append(False, number[:-1]) & ~begins
    plain = np.where(number, _NUMBER_CODE, np.where(unit, _UNIT_CODE, hashes))
    slot = number | unit
    name = (kinds & 3 == NAME) & ~slot
    return plain, slot, np.where(name, _NAME_CODE, plain), slot | name


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` codes from each place on."""
    n = len(codes) - size + 1
    h = np.full(max(n, 0), np.uint64(size))
    if n > 0:
        for j in range(size):
            h = h * _PRIME ^ codes[j:j + n]
            h ^= h >> np.uint64(29)
    return h * np.uint64(0x9E3779B97F4A7C15)


def windows(texts: list[str], sizes: list[int], words: Vocabulary, held: np.ndarray | None = None) -> Iterator[tuple]:
    """(text number, place, size, view, hash, slots) of the windows of all texts that
    ``held`` (a bitmap of hashes; None: everything) may contain.

    At most half of a window's tokens may be placeholders. The second view only has
    windows with a name in them, the third has all windows and no slots. ``slots``
    lists place, type and value.
    """
    found = [TOKEN.findall(t) for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    of = np.repeat(np.arange(len(texts)), counts)
    start = np.cumsum(counts) - counts
    tokens = [t for ts in found for t in ts]
    hashes, kinds = words.look_up(tokens)
    begins = np.zeros(len(tokens), bool)
    begins[start[counts > 0]] = True
    plain, slot, named, any_slot = template(hashes, kinds, begins)
    for size in sizes:
        if len(tokens) < size:
            continue
        n = len(tokens) - size + 1
        whole = of[:n] == of[size - 1:]
        names_in = None
        for view, codes, slots in ((PLAIN, plain, slot), (NAMED, named, any_slot), (VERBATIM, hashes, np.zeros(len(tokens), bool))):
            filled = np.append(0, np.cumsum(slots))
            filled = filled[size:] - filled[:-size]
            good = whole & (2 * filled <= size)
            if view == PLAIN:
                names_in = filled
            elif view == NAMED:
                good &= filled > names_in
            h = window_hashes(codes, size)
            if held is not None:
                bit = h >> np.uint64(64 - _FILTER_BITS)
                good &= (held[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            for i in np.flatnonzero(good).tolist():
                text = int(of[i])
                yield text, i - int(start[text]), size, view, int(h[i].astype(np.int64)), [
                    (j, "number" if kinds[i + j] == NUMBER else "name" if view == NAMED and kinds[i + j] & 3 == NAME else "unit", tokens[i + j].lower())
                    for j in np.flatnonzero(slots[i:i + size]).tolist()]


_SLOTS = "array<struct<at: int, kind: string, value: string>>"
_SLOT_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))


def in_blocks(batches: Iterator[pa.RecordBatch], sizes: list[int], held: np.ndarray | None = None) -> Iterator[tuple]:
    """(rows, their texts, ``windows`` of these) of about ``AT_ONCE`` bytes of text at a time."""
    words = Vocabulary()
    for batch in batches:
        for a, b in blocks(batch, "text", AT_ONCE):
            part = batch.slice(a, b - a)
            texts = part.column("text").to_pylist()
            yield part, texts, windows(texts, sizes, words, held)


def template_windows(rows: DataFrame, carried: list[str], sizes: list[int], held: np.ndarray | None = None, short: bool = False) -> DataFrame:
    """The windows of ``rows.text``, of all ``sizes``, with the ``carried`` columns of their row.

    ``short`` (the benchmark): a text gives windows of the largest size that it has
    tokens for.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(held) if held is not None else None
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, found in in_blocks(batches, sizes, shared.value if shared else None):
            lengths = [len(TOKEN.findall(t)) for t in texts] if short else None
            out = [x for x in found if not short or x[2] == min(lengths[x[0]], sizes[-1])]
            which = pa.array([x[0] for x in out], pa.int64())
            columns = [part.column(c).take(which) for c in carried]
            if short:
                columns.append(pa.array([lengths[x[0]] for x in out], pa.int32()))
            columns += [pa.array([x[i] for x in out], kind) for i, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.int32()), (4, pa.int64()))]
            columns.append(pa.array([[{"at": s, "kind": k, "value": v} for s, k, v in x[5]] for x in out], _SLOT_TYPE))
            names = [*carried, *(["tokens"] if short else []), "place", "size", "view", "hash", "slots"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    ddl = f"{kinds}, {'tokens int, ' if short else ''}place int, size int, view int, hash long, slots {_SLOTS}"
    return rows.select(*carried, text_of(rows).alias("text")).mapInArrow(run, ddl)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bloom filter of ``hashes.hash`` as bytes; its size does not depend on their number."""
    top = F.shiftrightunsigned("hash", 64 - _FILTER_BITS)
    bits = hashes.groupBy(F.shiftrightunsigned(top, 3).alias("octet")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), top.bitwiseAND(F.lit(7)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
    out[np.asarray(bits.column("octet"))] = np.asarray(bits.column("bits")).astype(np.uint8)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 8, least: int = 5, share: float = 0.5, enough: int = 25) -> DataFrame:
    """Pairs of documents and benchmark items found in them, best match of each pair:
    doc_id, item_id, place and tokens (of the matched stretch, counted in tokens),
    covered, changed (any slot has another value), and ``text_key`` of the document.

    An item counts as found if windows on one diagonal, with consistent slots, cover
    ``share`` of its tokens or ``enough`` tokens, or if it is there word for word as a
    whole or with ``enough`` tokens on a diagonal, whatever other slots say. Items with
    fewer than ``least`` tokens have no window and are never found. Null texts have no tokens; null and
    repeated ids are carried as they are; an empty table gives an empty result.
    """
    bench = stored(template_windows(benchmark, ["item_id"], list(range(least, size + 1)), short=True), "benchmark")
    keys = text_key(docs)
    rows = docs.select(row_id().alias("uid"), "doc_id", *(c.alias(n) for n, c in keys.items()), text_of(docs).alias("text"))
    theirs = bench.select("item_id", "tokens", F.col("place").alias("item_place"), "size", "view", "hash", F.col("slots").alias("item_slots"))
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # size - least + 1 values at most
    hits = template_windows(rows, ["uid", "doc_id", *keys], sizes, bitmap(bench)).join(theirs, ["size", "view", "hash"])
    one = ["uid", "doc_id", *keys, "item_id", "tokens", "view", F.col("place") - F.col("item_place")]
    slots = F.zip_with("slots", "item_slots", lambda s, t: F.struct(
        s["kind"].alias("kind"), s["value"].alias("value"), t["value"].alias("item_value")))
    along = hits.groupBy(*one[:-1], one[-1].alias("shift")).agg(
        F.array_sort(F.collect_set(F.struct("item_place", "size"))).alias("at"), F.array_distinct(F.flatten(F.collect_set(slots))).alias("slots"))
    # tokens covered by windows in order of place: each adds what lies behind the end so far
    covered = F.aggregate(
        "at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, w: F.struct(
            (a["n"] + F.greatest(F.lit(0), w["item_place"] + w["size"] - F.greatest(a["end"], w["item_place"]))).alias("n"),
            F.greatest(a["end"], w["item_place"] + w["size"]).alias("end")))
    n_pairs = F.size("slots")
    one_to_one = (F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["value"])))) == n_pairs) & (
        F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["item_value"])))) == n_pairs)
    judged = along.where(one_to_one).withColumn("match", covered).withColumn("covered", F.col("match.n")).where(
        (F.col("covered") >= F.when(F.col("view") == VERBATIM, 1.0).otherwise(share) * F.col("tokens")) | (F.col("covered") >= enough))
    first = F.element_at("at", 1)["item_place"]
    best = F.struct(
        "covered", (-F.col("shift")).alias("back"), (F.col("shift") + first).alias("place"), (F.col("match.end") - first).alias("tokens"),
        F.exists("slots", lambda s: s["value"] != s["item_value"]).alias("changed"))
    return judged.groupBy("uid", "doc_id", *keys, "item_id").agg(F.max(best).alias("best")).select(
        "doc_id", "item_id", "best.place", "best.tokens", "best.covered", "best.changed", *keys)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found."""
    keys = text_key(docs)
    leaks = find_leaks(docs, benchmark, **options).select(*keys).distinct()
    return docs.withColumns(keys).join(leaks, list(keys), "left_anti").select(*docs.columns)
