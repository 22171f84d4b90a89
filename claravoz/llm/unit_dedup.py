"""Repeated text across documents, by digests of normalised units.

A text is cut into units: paragraphs, lines, sentences, or phrases (sentences,
also cut before a capitalised word or a script without spaces, as a passage may be
pasted in the middle of a sentence). Units are normalised and hashed; digests are grouped over the whole
corpus; the occurrence that is ranked first (smallest document, then place) stays
and all others are removed. Neighbouring removed units form a span, which keeps
the offsets of the original text.

Pieces of few words ("The.") repeat by chance, so each begins a run: it and the
pieces behind it up to ``least_chars`` characters, whatever text is around. All runs
are units, as is the last run of a text, and a short line as a whole from
``LINE_CHARS`` characters on. Short pieces behind a long unit also go with it if the
same pieces follow it in the place that stays. Runs overlap, so a place that stays
may lose a part by another unit; that part has an earlier place, in which it stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from claravoz.llm.byte_bpe import blocks
from claravoz.llm.tables import row_id, stored, text_key, text_of

#: Letters of scripts without spaces (Thai to Khmer, kana, Han); three count as a word.
_UNSPACED = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"
_SENTENCE = r"\s*\n\s*|(?<=[.!?])\s+|(?<=[。！？])\s*"
CUTS = {
    "paragraph": re.compile(r"\s*\n\s*\n\s*"),
    "line": re.compile(r"\s*\n\s*"),
    "sentence": re.compile(_SENTENCE),
    "phrase": re.compile(_SENTENCE + r"|\s+(?=[A-ZÀ-Þ][a-zß-ÿ]|" + _UNSPACED + ")"),
}
_ENDS = " \t\r\n.,;:!?。！？"
#: Least characters of a short line that is a unit of its own.
LINE_CHARS = 12


def units(text: str, cut: re.Pattern) -> Iterator[tuple[int, int]]:
    """Start and end (code points) of the units that have something between the cuts."""
    start = 0
    for gap in cut.finditer(text):
        if gap.start() > start:
            yield start, gap.start()
        start = gap.end()
    if start < len(text):
        yield start, len(text)


def normal(unit: str) -> str:
    """The words of a unit in lower case, with single blanks and without punctuation at the ends."""
    return " ".join(unit.strip(_ENDS).lower().split())


def n_words(normed: str) -> int:
    return normed.count(" ") + 1 + (0 if normed.isascii() else len(re.findall(_UNSPACED, normed)) // 3)


def _bits(words: str) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(words)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:12], "big", signed=True)


def digested_units(text: str, cut: re.Pattern, least_words: int, least_chars: int) -> list[tuple]:
    """(high, low, tail, start, end, tail_end, piece, n, more) of all units, in order of ``piece``,
    the number of a unit's first piece: 96 bits of digest; of a unit of ``least_words`` words
    or more, digest (0: none) and end of the short pieces behind it; how many pieces the
    unit and those behind it are."""
    pieces = [(words, a, b) for a, b in units(text, cut) if (words := normal(text[a:b]))]
    count, last = len(pieces), len(pieces) - 1
    short = [n_words(words) < least_words for words, _, _ in pieces]
    sums = np.cumsum([0, *(len(words) for words, _, _ in pieces)]).tolist()
    out, follows = [], count  # follows: the first long piece behind

    def run(i: int, j: int, mark: str = "") -> None:
        out.append((*_bits(mark + "\n".join(words for words, _, _ in pieces[i:j])), 0, pieces[i][1], pieces[j - 1][2], pieces[j - 1][2], i, j - i, 0))

    stop = first_of_line = count
    for i in range(last, -1, -1):
        words, start, end = pieces[i]
        if short[i]:
            while stop - 1 > i and sums[stop - 1] - sums[i] >= least_chars:
                stop -= 1
            if sums[stop] - sums[i] >= least_chars:
                run(i, stop)
        else:
            tail = [w for w, _, _ in pieces[i + 1:follows]]
            digest = xxhash.xxh3_64_intdigest("\n".join(tail)) - (1 << 63) or 1 if tail else 0
            out.append((*_bits(words), digest, start, end, pieces[follows - 1][2] if tail else end, i, 1, len(tail)))
            follows = i
        if i == 0 or "\n" in text[pieces[i - 1][2]:start]:  # a line begins
            if all(short[i:first_of_line]) and sums[first_of_line] - sums[i] >= LINE_CHARS:
                run(i, first_of_line, "\n")
            first_of_line = i
    if count and short[last] and sums[count] >= least_chars:
        i = next(i for i in range(last, -1, -1) if sums[count] - sums[i] >= least_chars)
        if not short[i] or sums[last] - sums[i] >= least_chars:  # else it is the run from i on
            run(i, count)
    out.sort(key=lambda u: u[6])
    return out


_FIELDS = (("high", "long", pa.int64()), ("low", "int", pa.int32()), ("tail", "long", pa.int64()),
           ("start", "int", pa.int32()), ("end", "int", pa.int32()), ("tail_end", "int", pa.int32()),
           ("piece", "int", pa.int32()), ("n", "int", pa.int32()), ("more", "int", pa.int32()))


def document_units(docs: DataFrame, unit: str, least_words: int, least_chars: int) -> DataFrame:
    """One row per document: uid, doc_id, its ``text_key``, and an array for each field of
    its units."""
    cut = CUTS[unit]
    keys = text_key(docs)
    first = ["uid", "doc_id", *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch, "text", 4_000_000):
                part = batch.slice(a, b - a)
                found = [digested_units(text, cut, least_words, least_chars) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in first),
                     *(pa.array([[u[i] for u in us] for us in found], pa.list_(kind)) for i, (_, _, kind) in enumerate(_FIELDS))],
                    names=[*first, *(name for name, _, _ in _FIELDS)])

    text = text_of(docs)
    rows = docs.select(row_id().alias("uid"), "doc_id", *(c.alias(n) for n, c in keys.items()), text.alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{kinds}, " + ", ".join(f"{name} array<{kind}>" for name, kind, _ in _FIELDS))


def repeated_spans(docs: DataFrame, unit: str = "phrase", least_words: int = 5, least_chars: int = 50) -> DataFrame:
    """One row per document that loses text: uid, doc_id, ``text_key``, copy (which of
    several rows with this key it is, from 1), spans (start, end, keep_doc_id;
    sorted, code points, end exclusive).

    Null texts have no units; null ids rank last; rows that repeat a document lose
    what the first of them has. An empty table gives an empty result.
    """
    rows = stored(document_units(docs, unit, least_words, least_chars), "units")
    keys = list(text_key(docs))
    names = [name for name, _, _ in _FIELDS]
    each = rows.select("uid", "doc_id", F.explode(F.arrays_zip(*names)).alias("unit")).select(
        "uid", "doc_id", *(F.col(f"unit.{n}").alias(n) for n in names))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("uid").alias("uid"),
                    F.col("piece").alias("piece"), F.col("tail").alias("tail"))
    repeated = each.groupBy("high", "low").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("times")).where("times > 1")
    # the place that stays is not cut by a repeat that begins inside it
    later = each.drop("doc_id").join(repeated, ["high", "low"]).where((F.col("uid") != F.col("best.uid")) | (F.col("piece") >= F.col("best.piece") + F.col("n")))
    same = F.col("tail") == F.col("best.tail")
    order = Window.partitionBy("uid").orderBy("piece", "n", "high")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    spans = (later.select("uid", "piece", "n", "high", "start", F.when(same, F.col("tail_end")).otherwise(F.col("end")).alias("end"),
                          (F.col("piece") + F.col("n") + F.when(same, F.col("more")).otherwise(0)).alias("next"), F.col("best.doc_id").alias("keep"))
             # a span goes on if nothing that stays lies between two units
             .withColumn("breaks", F.when(F.max("next").over(before) >= F.col("piece"), 0).otherwise(1))
             .withColumn("island", F.sum("breaks").over(order))
             .groupBy("uid", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("keep", "piece").alias("keep_doc_id"))
             .groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "keep_doc_id"))).alias("spans")))
    named = rows.select("uid", "doc_id", *keys).withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy("uid")))
    return named.join(spans, "uid")


@F.arrow_udf(StringType())
def without(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Each text without its spans."""
    out = []
    for text, s, e in zip(texts, starts.to_pylist(), ends.to_pylist()):
        text, edges = text.as_py(), [0, *np.ravel(list(zip(s or [], e or []))).astype(int).tolist(), None]
        out.append(None if text is None else "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
    return pa.array(out, pa.string())


def _joined(docs: DataFrame, how: str, unit: str, least_words: int, least_chars: int) -> DataFrame:
    """``docs`` with ``_key_spans``; the texts are shuffled once. Of rows that repeat id and
    text all but the first lose the same, so a key has two lists of spans at most."""
    keys = text_key(docs)
    spans = repeated_spans(docs, unit, least_words, least_chars).groupBy(*keys).agg(
        F.max(F.when(F.col("copy") == 1, F.col("spans"))).alias("_key_first"),
        F.max(F.when(F.col("copy") > 1, F.col("spans"))).alias("_key_rest"))
    numbered = docs.withColumns(keys).withColumn("_key_copy", F.row_number().over(Window.partitionBy(*keys).orderBy("_key_size")))
    both = numbered.join(spans, list(keys), how)
    return both.withColumn("_key_spans", F.when(F.col("_key_copy") == 1, F.col("_key_first")).otherwise(F.col("_key_rest")))


def changed(docs: DataFrame, unit: str = "phrase", least_words: int = 5, least_chars: int = 50) -> DataFrame:
    """doc_id, spans and clean_text of the documents that lose text."""
    both = _joined(docs, "inner", unit, least_words, least_chars).where(F.col("_key_spans").isNotNull())
    return both.select("doc_id", F.col("_key_spans").alias("spans"), without("text", "_key_spans.start", "_key_spans.end").alias("clean_text"))


def clean(docs: DataFrame, unit: str = "phrase", least_words: int = 5, least_chars: int = 50) -> DataFrame:
    """All rows of ``docs`` with the repeated spans taken out of ``text``; other
    columns as they were. A null text stays null."""
    both = _joined(docs, "left", unit, least_words, least_chars)
    return both.withColumn("text", without("text", "_key_spans.start", "_key_spans.end")).select(*docs.columns)
