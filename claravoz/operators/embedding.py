"""Text vectors: a pluggable model, or hashed word counts computed in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claravoz.functions import vectors

# Fixed value: vector length of the sentence model the stores were made for.
DIMENSIONS = 384
# Fixed value: texts per call of a plugged-in model.
BATCH_SIZE = 32


def words(c: Column) -> Column:
    """Lower-case words: runs of letters and numbers."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(c: Column) -> Column:
    """Character trigrams of the words, each padded with a blank on both sides."""
    padded = F.concat(F.lit(" "), F.array_join(words(c), "  "), F.lit(" "))
    starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1)))
    return F.transform(starts, lambda i: F.substr(padded, i, F.lit(3)))


def word_slot(word: Column, dimensions: int = DIMENSIONS) -> Column:
    """Vector position of a word: leading 32 bits of its MD5, modulo the length."""
    bits = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long")
    return (bits % dimensions).cast("string")


def hashed_vectors(df: DataFrame, text_col: str, output: str = "embedding",
                   dimensions: int = DIMENSIONS, trigrams: bool = False) -> DataFrame:
    """Add unit vectors of hashed word (or trigram) counts over the whole text.

    The counting is Spark ML's, so no row leaves the JVM.
    """
    tokens = globals()["trigrams"](F.col(text_col)) if trigrams else words(F.col(text_col))
    slots = F.transform(F.coalesce(tokens, F.array()), lambda w: word_slot(w, dimensions))
    counter = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(dimensions)], inputCol="_slots", outputCol="_counts"
    )
    counted = counter.transform(df.withColumn("_slots", slots))
    return counted.withColumn(output, vectors.unit(vector_to_array("_counts"))) \
        .withColumn(output, F.col(output).cast("array<float>")).drop("_slots", "_counts")


def model_vectors(df: DataFrame, text_col: str, load: Callable[[], Callable[[Sequence[str]], object]],
                  output: str = "embedding", batch_size: int = BATCH_SIZE) -> DataFrame:
    """Add vectors from a plugged-in model.

    ``load`` is called once per task and returns a function from a list of
    texts to a two-dimensional array. Null texts are encoded as empty.
    """
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            rows: list = []
            filled = texts.fillna("").tolist()
            for start in range(0, len(filled), batch_size):
                rows.extend(list(map(float, v)) for v in model(filled[start:start + batch_size]))
            yield pd.Series(rows)

    return df.withColumn(output, encode(F.col(text_col)))
