"""Exact duplicates by a tree merge of sorted digest runs.

Every partition of the table is a run: its distinct digests, sorted, each with
its best row and its number of rows. Runs are exchanged in binomial rounds. In
round ``r`` the runs whose numbers agree above the lowest ``r * bits`` bits meet
and are merged ``2 ** bits`` ways by digest, so copies shrink at every level and
no digest ever has more than ``2 ** bits`` rows in one merge, however many
copies there are. Then the winners go down the same tree: a level joins the one
above it, and the rows join their own run. No join has a key with more rows than
one partition holds.

Two texts count as equal when SHA-256, length and XXH64 of the normalised text
all agree; this is verified at every level, as all three are keys of the merge.

Only DataFrame operations are used. What moves is a digest and a few numbers a
row; texts stay where they are, but for ``keep_first``, which returns whole rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claravoz.llm.tables import keep_rows, row_id, stored, text_key, text_of

BLANKS = r"[\x20\x09-\x0D]+"
_SAME = ("digest", "n_norm", "verify")


def normalised(text: Column) -> Column:
    """``text`` without its ASCII white space."""
    return F.regexp_replace(text, BLANKS, "")


def digests(docs: DataFrame) -> DataFrame:
    """One narrow row per document: run, row number, key of equality, rank."""
    text = text_of(docs)
    bare = normalised(text)
    return docs.select(
        F.spark_partition_id().alias("run"), row_id().alias("uid"), F.col("doc_id"),
        F.length(text).alias("n_points"), F.unhex(F.sha2(bare, 256)).alias("digest"),
        F.length(bare).alias("n_norm"), F.xxhash64(bare).alias("verify"),
        *(c.alias(name) for name, c in text_key(docs).items()),
    )


def _best() -> Column:
    """Rank of a row: longest original text, then smallest id, null ids last."""
    return F.struct(
        (-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"),
        F.col("doc_id").alias("doc_id"), F.col("uid").alias("uid"),
    )


def find_copies(docs: DataFrame, bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256,
    and the columns of ``text_key``.

    ``docs`` has ``doc_id`` and ``text``; other columns are not looked at. A null
    text is empty, and all empty texts are copies of each other. Of rows that tie
    in length and id (repeated rows, null ids) exactly one is kept. An empty
    table gives an empty result. ``bits``: a merge takes ``2 ** bits`` runs.
    """
    rows = stored(digests(docs), "digests")
    level = stored(
        rows.groupBy("run", *_SAME).agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("n")), "run")
    levels = [level]
    last = rows.agg(F.max("run")).first()[0] or 0
    while last > 0:
        above = F.shiftright("run", bits).alias("run")
        level = stored(
            level.groupBy(above, *_SAME).agg(F.min("best").alias("best"), F.sum("n").alias("n")), "run")
        levels.append(level)
        last >>= bits
    won = levels.pop()
    while levels:
        below = levels.pop().select(F.col("run").alias("child"), F.shiftright("run", bits).alias("run"), *_SAME)
        won = below.join(won, ["run", *_SAME]).select(F.col("child").alias("run"), *_SAME, "best", "n")
    return rows.join(won, ["run", *_SAME]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("uid") == F.col("best.uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), *text_key(docs),
    )


def keep_first(docs: DataFrame, bits: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows that repeat both id and text one stays, whichever.
    """
    return keep_rows(docs, find_copies(docs, bits).where("kept"))
