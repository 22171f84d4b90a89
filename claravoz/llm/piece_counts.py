"""Token counts of a sentencepiece model without token ids.

No piece of such a model has its blank mark after another character, so nothing
is ever merged across the start of a run of spaces. The text between two such
starts is a pre-token. The library counts the pieces of every distinct pre-token
once; a document's count is the sum over its pre-tokens.

The counts are joined to the documents' pre-token frequencies. The most frequent
pre-tokens, as many as fit in ``head_bytes``, are looked up in a broadcast table;
all others go through a join on the pre-token. Both give the same sum, only the
second moves rows, and it has no frequent key.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claravoz.llm.byte_bpe import blocks, tokenizer_path
from claravoz.llm.tables import row_id, stored, text_of

MODEL = "piece_bpe_32k.model"
#: Distinct pre-tokens that a task holds before it hands its counts on.
HELD = 400_000
_RUN = re.compile(" +[^ ]*")
_MARK = "▁"


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without the first of its blanks.

    The library puts a blank before the text, and takes its blank mark for a blank.
    """
    if not text:
        return []
    plain = text.replace(_MARK, " ")
    parts = plain.split(" ")
    return parts if all(parts) else [run[1:] for run in _RUN.findall(" " + plain)]


def piece_counts(keys: list[str], path: str) -> list[int]:
    """Pieces of each pre-token; the library adds the blank that was taken off.

    The empty key is a blank alone, which is one piece.
    """
    return [len(ids) if key else 1 for key, ids in zip(keys, processor(path).encode(keys, num_threads=1))]


def pretoken_frequencies(docs: DataFrame) -> DataFrame:
    """(pretoken, n) over all texts; counts combine in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["pretoken", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                seen.update(pretokens(text.as_py()))
                if len(seen) > HELD:
                    yield flush()
        yield flush()

    found = docs.select(text_of(docs).alias("text")).mapInArrow(run, "pretoken string, n long")
    return found.groupBy("pretoken").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, path: str) -> DataFrame:
    """(pretoken, n, pieces): every distinct pre-token, counted once by the library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = piece_counts(batch.column("pretoken").to_pylist(), path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int32())], names=["pretoken", "n", "pieces"])

    return stored(pretoken_frequencies(docs).mapInArrow(run, "pretoken string, n long, pieces int"), "pieces")


def frequent(words: DataFrame, head_bytes: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens that take ``head_bytes`` at most,
    16 bytes each besides the text. Their least frequency is found from sizes by
    frequency, about the square root of the number of tokens at most."""
    sizes = words.where("n > 1").groupBy("n").agg(F.sum(F.octet_length("pretoken") + 16).alias("size")).toArrow()
    order = np.argsort(-np.asarray(sizes.column("n")), kind="stable")
    within = np.cumsum(np.asarray(sizes.column("size"))[order]) <= head_bytes
    if not within.any():
        return {}
    least = int(np.asarray(sizes.column("n"))[order][within][-1])
    head = words.where(F.col("n") >= least).select("pretoken", "pieces").toArrow()
    return dict(zip(head.column("pretoken").to_pylist(), head.column("pieces").to_pylist()))


def count_tokens(docs: DataFrame, path: str | None = None, head_bytes: int = 12_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of ``docs`` (doc_id, text).

    A null or empty text has 0 tokens. No begin, end or added tokens; special
    strings in a text are ordinary text, as in the library. Repeated rows and null
    ids are kept; other columns are not looked at.
    """
    path = path or tokenizer_path(MODEL)
    words = dictionary(docs, path)
    head = docs.sparkSession.sparkContext.broadcast(frequent(words, head_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value.get
        for batch in batches:
            for start, end in blocks(batch, "text", 4_000_000):
                part = batch.slice(start, end - start)
                sums, rest = [], []
                for text in part.column("text"):
                    keys = pretokens(text.as_py())
                    counts = list(map(known, keys))
                    if None in counts:
                        rare = Counter(k for k, c in zip(keys, counts) if c is None)
                        rest.append(list(rare.items()))
                        sums.append(sum(filter(None, counts)))
                    else:
                        rest.append([])
                        sums.append(sum(counts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid"), part.column("doc_id"), part.column("n_bytes"), pa.array(sums, pa.int64()),
                     pa.array([[k for k, _ in r] for r in rest], pa.list_(pa.string())), pa.array([[n for _, n in r] for r in rest], pa.list_(pa.int32()))],
                    names=["uid", "doc_id", "n_bytes", "known", "rare", "times"])

    text = text_of(docs)
    rows = docs.select(row_id().alias("uid"), F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = stored(rows.mapInArrow(run, "uid long, doc_id long, n_bytes long, known long, rare array<string>, times array<int>"), "frequencies")
    rare = (counted.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x"))
            .select("uid", F.col("x.rare").alias("pretoken"), F.col("x.times").alias("times"))
            .join(words.select("pretoken", "pieces"), "pretoken")
            .groupBy("uid").agg(F.sum(F.col("times") * F.col("pieces")).alias("others")))
    return counted.join(rare, "uid", "left").select(
        "doc_id", "n_bytes", (F.col("known") + F.coalesce("others", F.lit(0))).alias("n_tokens"))
