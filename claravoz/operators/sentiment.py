"""Sentiment scores: a Spark ML model by default, or a plugged-in scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claravoz.functions import scoring

# Fixed value: texts per call of a plugged-in scorer.
BATCH_SIZE = 32
# Output order of a two-class scorer.
TWO_CLASSES = ("NEGATIVE", "POSITIVE")


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "label",
          features: int = 1 << 14, iterations: int = 20) -> PipelineModel:
    """Words, hashed counts, inverse document frequency, logistic regression.

    Texts are read and cut once: the hashed counts are kept, in memory or on disk, until
    both fits are done.
    """
    words = RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
    hashed = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features)
    weighing = IDF(inputCol="_counts", outputCol="_features")
    fitting = LogisticRegression(featuresCol="_features", labelCol=label_col, maxIter=iterations,
                                 regParam=0.01, probabilityCol="_probability",
                                 rawPredictionCol="_raw", predictionCol="_predicted")
    given = labelled.select(text_col, F.col(label_col).cast("double").alias(label_col))
    counts = hashed.transform(words.transform(given)).select("_counts", label_col).persist()
    try:
        idf = weighing.fit(counts)
        return PipelineModel([words, hashed, idf, fitting.fit(idf.transform(counts))])
    finally:
        counts.unpersist()


def with_labels(df: DataFrame, positive: Column, negative: Column) -> DataFrame:
    """Add sentiment, confidence, positive_score and negative_score."""
    return df.withColumns({"positive_score": positive, "negative_score": negative}).withColumns({
        "sentiment": scoring.sentiment(F.col("positive_score"), F.col("negative_score")),
        "confidence": scoring.confidence(F.col("positive_score"), F.col("negative_score")),
    })


def score_with_model(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Score with a trained Spark ML model; no row leaves the JVM."""
    scored = model.transform(df)
    p = vector_to_array("_probability")
    labelled = with_labels(scored, F.get(p, F.lit(1)), F.get(p, F.lit(0)))
    return labelled.select(*df.columns, "sentiment", "confidence", "positive_score", "negative_score")


def class_probabilities(texts: Column, load: Callable[[], Callable[[Sequence[str]], object]],
                        batch_size: int = BATCH_SIZE) -> Column:
    """Softmax of a plugged-in scorer's logits, as an array in its label order.

    ``load`` is called once per task and returns a function from a list of
    texts to logits with one row per text. Null texts give null. Only the texts
    of one call are Python strings at a time; the others stay in Arrow's buffer.
    """
    @F.arrow_udf("array<double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for found in batches:
            out: list = [None] * len(found)
            known = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            for start in range(0, len(known), batch_size):
                at = known[start:start + batch_size]
                logits = np.asarray(model(found.take(pa.array(at)).to_pylist()), dtype=np.float64)
                powers = np.exp(logits - logits.max(axis=1, keepdims=True))
                shares = powers / powers.sum(axis=1, keepdims=True)
                for i, row in zip(at, shares):
                    out[i] = row.tolist()
            yield pa.array(out, pa.list_(pa.float64()))

    return predict(texts)


def score_texts(df: DataFrame, load: Callable[[], Callable[[Sequence[str]], object]],
                text_col: str = "text", labels: Sequence[str] = TWO_CLASSES,
                batch_size: int = BATCH_SIZE) -> DataFrame:
    """Score with a plugged-in scorer that declares its labels.

    Two classes give sentiment, confidence and both scores; five classes give
    the label and its probability.
    """
    p = class_probabilities(F.col(text_col), load, batch_size)
    scored = df.withColumn("_p", p)
    if len(labels) == 2:
        at = {label.upper(): F.get("_p", F.lit(i)) for i, label in enumerate(labels)}
        labelled = with_labels(scored, at["POSITIVE"], at["NEGATIVE"])
        return labelled.withColumn(
            "sentiment", F.when(F.col("_p").isNotNull(), F.col("sentiment"))).drop("_p")
    names = F.array(*(F.lit(x) for x in labels))
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    return scored.withColumns({
        "sentiment": F.element_at(names, best), "confidence": F.array_max("_p"),
    }).drop("_p")


class SentimentTransformer(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Stage that scores a text column with the model saved at ``modelPath``."""

    modelPath = Param(Params._dummy(), "modelPath", "saved sentiment model",
                      typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCol: str = "text", modelPath: str = ""):
        super().__init__()
        self._setDefault(inputCol="text", modelPath="")
        self._set(**self._input_kwargs)
        self._model: PipelineModel | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self._model is None:
            self._model = PipelineModel.load(self.getOrDefault("modelPath"))
        trained_on = self._model.stages[0].getInputCol()
        source = dataset.withColumn(trained_on, F.col(self.getInputCol()))
        scored = score_with_model(source, self._model)
        return scored if trained_on in dataset.columns else scored.drop(trained_on)
