"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary text, give the probability of a word after
the word before it. All counts are continuation counts: an expression counts once
for each distinct text of its class that has it, so a text that repeats itself
says no more than another. Word pairs back off to words with absolute
discounting, words back off to what both models share: how many documents of the
whole corpus have the word, counted for every word there is. An expression whose counts do not tell
the classes apart (log-likelihood ratio below ``evidence``: the rare ones, and
most common ones) has no count of its own and is left to the backoff, where it is
the same for both. The models are fitted on a bounded number of rows, so they
are bounded too and can be broadcast. Where a class has more rows than the bound,
the evidence and the curve weight each class by the inverse of the rate at which it
was drawn, so they see the classes as they are among all labelled rows.

A text's score compares both log-likelihoods per expression, and per root of the
number of expressions, since chance differences shrink so in long texts. A
logistic curve, fitted on the rows that the models learned from, makes a
probability of the two.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claravoz.llm.byte_bpe import blocks
from claravoz.llm.language_id import held_out
from claravoz.llm.tables import stored, text_of

DISCOUNT = 0.75
#: Pull of the curve's weights to zero; it keeps them finite where the classes do not overlap.
RIDGE = 0.3
_WORD = re.compile(r"[^\W\d_]+")
_PARTS, _PART = 3, 1


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Model:
    """Log ratios toxic to ordinary, of words and of words after another one, and the curve."""

    words: dict[str, float] = field(default_factory=dict)
    pairs: dict[tuple[str, str], float] = field(default_factory=dict)
    other: float = 0.0
    curve: tuple[float, float, float] = (0.0, 0.0, -20.0)

    def compare(self, text: str) -> tuple[float, float]:
        """Difference of the log-likelihoods per expression, and per root of their number."""
        words = words_of(text)
        if not words:
            return 0.0, 0.0
        pairs, one, two = set(zip(words, words[1:])), self.words, self.pairs
        n = len(pairs) + 1
        total, known = 0.0, 0
        if words[0] in one:
            total, known = one[words[0]], 1
        for pair in pairs:
            if pair[1] in one:
                total += two[pair] if pair in two else one[pair[1]]
                known += 1
        total += (n - known) * self.other
        return total / n, total / math.sqrt(n)

    def score(self, text: str) -> float:
        a, b = self.compare(text)
        z = self.curve[0] * a + self.curve[1] * b + self.curve[2]
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def training_texts(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, tuple[float, float]]:
    """(text, toxic): distinct texts of at most ``most`` labelled rows of each class, the
    first in the order of a hash of their ids; held-out ids are left out. A text
    with both labels is toxic. The chosen ids are broadcast: 16 bytes times ``2 * most``.
    And labelled rows for each one drawn, of ordinary and of toxic rows."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", _PARTS, _PART)) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows_of = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("toxic = 1").orderBy(*order).limit(most).union(known.where("toxic = 0").orderBy(*order).limit(most))
    rows = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = stored(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "training")
    return texts, tuple(max(1.0, rows_of.get(c, 0) / most) for c in (0, 1))


def _counted(texts: DataFrame, expressions) -> DataFrame:
    """(before, word, ordinary, toxic): for every key (before, word) that ``expressions`` gives
    for a text's words, the sum of its values over the texts of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                 *(pa.array([c[k] for k in keys], pa.int64()) for c in seen)], names=["before", "word", "ordinary", "toxic"])
            seen[0].clear()
            seen[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                seen[toxic].update(expressions(words_of(text.as_py())))
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield flush()
        yield flush()

    counted = texts.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(
        run, "before string, word string, ordinary long, toxic long")
    return counted.groupBy("before", "word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def word_counts_of(texts: DataFrame) -> DataFrame:
    """(word, ordinary, toxic): texts of each class with the word."""
    return _counted(texts, lambda words: {(None, w) for w in words}).select("word", "ordinary", "toxic")


def pair_counts_of(texts: DataFrame, kept: set[str]) -> DataFrame:
    """(before, word, ordinary, toxic): texts of each class with a pair that ends in one of
    ``kept``; where ``word`` is null, all pairs that begin with ``before``."""
    wanted = texts.sparkSession.sparkContext.broadcast(frozenset(kept))

    def expressions(words: list[str]) -> Counter:
        pairs = set(zip(words, words[1:]))
        out = Counter((a, None) for a, _ in pairs)
        out.update(p for p in pairs if p[1] in wanted.value)
        return out

    return _counted(texts, expressions)


def corpus_words(docs: DataFrame) -> DataFrame:
    """(word, n): every word of the whole corpus and the documents that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                seen.update(set(words_of(text.as_py())))
                if len(seen) > 400_000:
                    yield flush()
        yield flush()

    counted = docs.select(text_of(docs).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def shared_chance(docs: DataFrame, kept: set[str]) -> dict[str, float]:
    """The backoff of both models: chance of each kept word by its documents in the whole
    corpus, discounted, with an equal share of the discount for every word there is."""
    found = stored(corpus_words(docs), "vocabulary")
    total, kinds = found.agg(F.sum("n"), F.count(F.lit(1))).first()
    wanted = found.sparkSession.createDataFrame([(w,) for w in sorted(kept)], "word string")
    counts = {r["word"]: r["n"] for r in found.join(F.broadcast(wanted), "word").collect()}
    return {w: (max(counts.get(w, 0) - DISCOUNT, 0) + DISCOUNT) / max(1, total or 0) if kinds else 1.0 for w in kept}


def fit(docs: DataFrame, labels: DataFrame, evidence: float = 15.0, most: int = 10_000) -> Model:
    """Models of both classes. ``labels`` has doc_id and toxic (0, 1; other values and
    nulls are left out; of several labels of an id the largest counts). Without
    toxic or without ordinary rows nothing is learned and every score is about 0."""
    texts, weight = training_texts(docs, labels, most)
    size = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return Model()
    of_class = [size[c] * weight[c] for c in (0, 1)]
    # counts as if both classes were drawn at the lower of the two rates
    seen = {name: F.col(name) * (weight[c] / max(weight)) for c, name in enumerate(("ordinary", "toxic"))}
    both = seen["ordinary"] + seen["toxic"]
    ratio = 2 * sum(F.when(n > 0, n * F.ln(n / (both * (of_class[c] / sum(of_class))))).otherwise(0.0) for c, n in enumerate(seen.values()))
    single = stored(word_counts_of(texts), "words")
    everything = single.agg(F.sum("ordinary"), F.sum("toxic")).first()
    word_counts = {r["word"]: (r["ordinary"], r["toxic"]) for r in single.where(ratio >= evidence).collect()}
    if not word_counts:
        return Model()
    pairs = stored(pair_counts_of(texts, set(word_counts)), "pairs")
    totals = pairs.where(F.col("word").isNull()).select("before", F.col("ordinary").alias("all_ordinary"), F.col("toxic").alias("all_toxic"))
    pair_rows = pairs.where(F.col("word").isNotNull() & (ratio >= evidence)).join(totals, "before").collect()
    model = ratios(word_counts, tuple(everything), pair_rows, shared_chance(docs, set(word_counts)))
    model.curve = fit_curve(texts, model, weight)
    return model


def ratios(word_counts: dict, everything: tuple, pair_rows: list, shared: dict[str, float]) -> Model:
    """Log ratios of both models: for words, for pairs, and for all words without a count."""
    chance: list[dict[str, float]] = []
    for c, total in enumerate(everything):
        left = DISCOUNT * max(1, sum(n[c] > 0 for n in word_counts.values())) / total
        chance.append({w: max(n[c] - DISCOUNT, 0) / total + left * shared[w] for w, n in word_counts.items()})
    rest = [max(1e-9, 1 - sum(p.values())) for p in chance]
    kinds: Counter = Counter()
    for r in pair_rows:
        kinds.update((c, r["before"]) for c, name in enumerate(("ordinary", "toxic")) if r[name])
    pairs = {}
    for r in pair_rows:
        p = []
        for c, (n, total) in enumerate(((r["ordinary"], r["all_ordinary"]), (r["toxic"], r["all_toxic"]))):
            back = chance[c][r["word"]]
            left = kinds[c, r["before"]]
            p.append(max(n - DISCOUNT, 0) / total + DISCOUNT * left / total * back if left else back)
        pairs[r["before"], r["word"]] = math.log(p[1] / p[0])
    return Model({w: math.log(chance[1][w] / chance[0][w]) for w in word_counts}, pairs, math.log(rest[1] / rest[0]))


def fit_curve(texts: DataFrame, model: Model, weight: tuple[float, float] = (1.0, 1.0)) -> tuple[float, float, float]:
    """Weights of the two comparisons and the constant, by Newton's method on the
    training texts' comparisons (three numbers for each of a bounded number of rows);
    a text counts by the ``weight`` of its class, over their mean."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.compare(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), batch.column("toxic")],
                names=["a", "b", "toxic"])

    rows = texts.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "a double, b double, toxic int").toArrow()
    x = np.column_stack([np.asarray(rows.column("a")), np.asarray(rows.column("b"))])
    y = np.asarray(rows.column("toxic")).astype(float)
    v = np.where(y == 1, weight[1], weight[0])
    v /= v.mean()
    middle = (v[:, None] * x).mean(0)
    width = np.sqrt((v[:, None] * (x - middle) ** 2).mean(0)) + 1e-9
    z = np.column_stack([(x - middle) / width, np.ones(len(x))])
    w = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (v * p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(3), z.T @ (v * (y - p)) - RIDGE * w)
        w += step / max(1.0, float(np.abs(step).max()))  # short steps where the classes are far apart
    return float(w[0] / width[0]), float(w[1] / width[1]), float(w[2] - (w[:2] * middle / width).sum())


def score(docs: DataFrame, labels: DataFrame, evidence: float = 15.0, most: int = 10_000, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``least`` on) for every row of ``docs``.

    A null or empty text gets the score of no evidence. Null and repeated ids keep
    their rows, a null id is neither held out nor labelled. Other columns than
    doc_id and text are not looked at. An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, evidence, most))

    @F.arrow_udf("double")
    def toxic(texts: pa.Array) -> pa.Array:
        one = pa.RecordBatch.from_arrays([texts], names=["text"])
        return pa.array([model.value.score(t.as_py()) for a, b in blocks(one, "text") for t in texts.slice(a, b - a)], pa.float64())

    told = docs.select("doc_id", held_out("doc_id", _PARTS, _PART).alias("held_out"), toxic(text_of(docs)).alias("score"))
    return told.withColumn("predicted", F.when(F.col("score") >= least, 1).otherwise(0))
