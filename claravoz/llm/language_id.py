"""Language identification with bit-sliced Bloom filters of letter trigrams.

One table of slots holds the filters of all languages: a slot is a bitmask with
a bit per language, and the masks at a trigram's ``HASHES`` slots, and-ed, name
every language that contains it, in one look-up however many languages there
are. A text's masks are counted per language (popcounts by bit). A filter also
says yes by chance, with a rate that its own fill gives; the counts are corrected
for it. The language with the largest corrected count decides.

Fitting counts trigrams per language in the tasks and merges the counts by key.
A trigram enters a language's filter if its relative frequency there is at least
``share`` of the largest one in any language, which keeps passages quoted in
another language from filling the filter. The table has a fixed size, a parameter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claravoz.llm.byte_bpe import blocks
from claravoz.llm.tables import text_of

HASHES = 3
UNDECIDED = "und"
#: Bytes of text whose trigrams are held at once, some 100 bytes for each of text.
AT_ONCE = 1_000_000
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Lower-case code point of every letter, 1 for everything else."""
    table = np.ones(0x110000, np.uint32)
    for c in range(0x110000):
        char = chr(c)
        if char.isalpha():
            low = char.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of letters of all texts, each packed in 63 bits, and the text of each.

    Runs of other characters count as one blank, also around the text. A trigram
    needs a letter in its middle.
    """
    points = np.frombuffer("\0\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = letters()[points]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    of = np.repeat(np.arange(len(texts) + 1), np.append(sizes + 2, 2))[:len(code)]
    keep = np.append(True, (code[1:] != 1) | (code[:-1] != 1))
    keep |= np.append(False, of[1:] != of[:-1])  # a blank of its own on both sides of a text
    code, of = code[keep].astype(np.uint64), of[keep]
    if len(code) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    middle = (code[1:-1] != 1) & (of[1:-1] == of[1:-1])
    packed = (code[:-2] << np.uint64(42)) | (code[1:-1] << np.uint64(21)) | code[2:]
    return packed[middle], of[1:-1][middle]


def slots(grams: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The slots of each trigram, one array per hash function."""
    mixed = grams ^ (grams >> np.uint64(31))
    for m in _MULTIPLIERS[:HASHES]:
        yield ((mixed * np.uint64(m)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Filters:
    """Slot masks, the languages by bit, and the rate of chance hits per language."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray

    @property
    def bits(self) -> int:
        return int(len(self.masks)).bit_length() - 1

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text; the score is the share of its trigrams
        that the filter of the winner accounts for, after correction."""
        grams, of = trigrams(texts)
        held = None
        for at in slots(grams, self.bits):
            held = self.masks[at] if held is None else held & self.masks[at]
        total = np.bincount(of, minlength=len(texts) + 1)[:len(texts)].astype(float)
        hits = np.zeros((len(texts), len(self.languages)))
        for low in range(0, len(self.languages), 8):
            byte = (held >> np.uint64(low)).astype(np.int64) & 255
            seen = np.bincount(of * 256 + byte, minlength=(len(texts) + 1) * 256).reshape(-1, 256)[:len(texts)]
            width = min(8, len(self.languages) - low)
            hits[:, low:low + width] = seen @ ((np.arange(256)[:, None] >> np.arange(width)) & 1)
        total_ = np.maximum(total, 1)[:, None]
        fixed = np.clip((hits / total_ - self.chance) / (1 - self.chance), 0, 1)
        if not self.languages:
            return [UNDECIDED] * len(texts), [0.0] * len(texts)
        best = fixed.argmax(1)
        sure = fixed[np.arange(len(texts)), best]
        names = [self.languages[b] if n else UNDECIDED for b, n in zip(best.tolist(), total.tolist())]
        return names, [float(s) if n else 0.0 for s, n in zip(sure, total)]


def count_trigrams(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of ``labelled`` (text, lang); counts combine in the
    tasks, so about one row per distinct trigram and task moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = defaultdict(lambda: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (grams, counts) in known.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)],
                    names=["lang", "gram", "n"])
            known.clear()

        for batch in batches:
            for start, end in blocks(batch, "text", AT_ONCE):
                part = batch.slice(start, end - start)
                langs, texts = np.array(part.column("lang").to_pylist()), part.column("text").to_pylist()
                for lang in dict.fromkeys(langs.tolist()):
                    found, n = np.unique(trigrams([texts[i] for i in np.flatnonzero(langs == lang)])[0], return_counts=True)
                    grams, counts = known[lang]
                    grams, inverse = np.unique(np.concatenate([grams, found]), return_inverse=True)
                    known[lang] = grams, np.bincount(inverse, np.concatenate([counts, n]), len(grams)).astype(np.int64)
            if sum(len(g) for g, _ in known.values()) > 2_000_000:
                yield from flush()
        yield from flush()

    counted = labelled.select("lang", text_of(labelled).alias("text")).mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, bits: int = 18, share: float = 0.2) -> Filters:
    """Filters from all rows of ``labelled`` (text, lang; null langs are left out).

    The counts stay in Spark; the driver gets the slots' masks, at most
    ``2 ** bits`` numbers, or-ed by slot. At most 63 languages. A table without
    labelled rows gives filters that decide nothing.
    """
    labelled = labelled.where(F.col("lang").isNotNull())
    counts = count_trigrams(labelled).persist()
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if len(languages) > 63:
        raise ValueError(f"{len(languages)} languages do not fit into a mask of 63 bits")
    if not languages:
        counts.unpersist()
        return Filters([], np.zeros(1 << bits, np.uint64), np.zeros(0))
    number = F.create_map(*(x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(i))))
    rate = F.col("n") / F.create_map(*(x for lang in languages for x in (F.lit(lang), F.lit(float(totals[lang])))))[F.col("lang")]
    per_gram = counts.groupBy("gram").agg(
        F.max(rate).alias("most"), F.collect_list(F.struct(number[F.col("lang")].alias("bit"), rate.alias("rate"))).alias("langs"))
    mask = F.aggregate(
        F.filter("langs", lambda x: x["rate"] >= share * F.col("most")), F.lit(0).cast("long"),
        lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["bit"])))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, masks = np.asarray(batch.column("gram")).view(np.uint64), np.asarray(batch.column("mask"))
            table = np.zeros(1 << bits, np.int64)
            for at in slots(grams, bits):
                np.bitwise_or.at(table, at, masks)
            used = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[used])], names=["slot", "mask"])

    filled = (per_gram.select("gram", mask.alias("mask")).mapInArrow(spread, "slot long, mask long")
              .groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow())
    counts.unpersist()
    masks = np.zeros(1 << bits, np.uint64)
    masks[np.asarray(filled.column("slot"))] = np.asarray(filled.column("mask")).view(np.uint64)
    fill = np.array([((masks >> np.uint64(i)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Filters(languages, masks, np.minimum(fill ** HASHES, 0.99))


def predict(docs: DataFrame, filters: Filters) -> tuple[Column, Column]:
    """Columns for the language and the score of ``docs.text``, from one Arrow UDF."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.arrow_udf("struct<lang: string, score: double>")
    def tell(texts: pa.Array) -> pa.Array:
        langs: list[str] = []
        scores: list[float] = []
        one = pa.RecordBatch.from_arrays([texts], names=["text"])
        for start, end in blocks(one, "text", AT_ONCE):
            a, b = shared.value.predict(texts.slice(start, end - start).to_pylist())
            langs += a
            scores += b
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    told = tell(text_of(docs))
    return told["lang"], told["score"]


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Rows kept from learning: CRC-32 of the id as text leaves ``part`` modulo ``parts``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, bits: int = 18, share: float = 0.2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    Learns from text and non-null lang of the rows that are not held out; a null
    id is never held out and never learned from. ``und`` with score 0 stands for a
    null text, one without a letter, and for all texts when nothing was learned.
    """
    out = held_out()
    filters = fit(docs.where(~out & F.col("doc_id").isNotNull()).select("text", "lang"), bits, share)
    lang, score = predict(docs, filters)
    return docs.select("doc_id", out.alias("held_out"), lang.alias("lang_pred"), score.alias("score"))


def reject_unknown(docs: DataFrame, least: float = 0.4, bits: int = 18, share: float = 0.2) -> DataFrame:
    """The rows of ``docs`` whose language is found with a score of ``least`` or more."""
    filters = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("text", "lang"), bits, share)
    lang, score = predict(docs, filters)
    told = docs.select("*", lang.alias("_li_lang"), score.alias("_li_score"))
    return told.where((F.col("_li_lang") != UNDECIDED) & (F.col("_li_score") >= least)).select(*docs.columns)
