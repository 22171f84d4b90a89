"""Ratios, severity scores and classifier outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the five-class sentiment model, lowest first.
FIVE_CLASSES = ("Very Negative", "Negative", "Neutral", "Positive", "Very Positive")


def ratio(part: Column, total: Column, digits: int = 4) -> Column:
    """part / total rounded half up to ``digits``; zero when total is zero.

    Spelt with floor so that every engine with IEEE doubles gives equal bits.
    """
    scale = float(10 ** digits)
    value = F.floor(part.cast("double") * F.lit(scale) / total.cast("double") + F.lit(0.5))
    return F.when(total == 0, F.lit(0.0)).otherwise(value.cast("double") / F.lit(scale))


def percent(part: Column, total: Column, digits: int = 2) -> Column:
    """100 * part / total rounded half up to ``digits``; zero when total is zero."""
    scale = float(10 ** digits)
    value = F.floor(part.cast("double") * F.lit(100 * scale) / total.cast("double") + F.lit(0.5))
    return F.when(total == 0, F.lit(0.0)).otherwise(value.cast("double") / F.lit(scale))


def severity_score(detractor_pct: Column, high_pct: Column, medium_pct: Column) -> Column:
    """Half the detractor share, 30 % of high churn, 20 % of medium churn."""
    return detractor_pct * 0.5 + high_pct * 0.3 + medium_pct * 0.2


def severity_level(score: Column) -> Column:
    """Critical from 40, high from 30, medium from 20, else low."""
    return (
        F.when(score >= 40, "critical").when(score >= 30, "high")
        .when(score >= 20, "medium").otherwise("low")
    )


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by the maximum."""
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total)


def sentiment(positive: Column, negative: Column) -> Column:
    """POSITIVE only when its score is the larger one; a tie is NEGATIVE."""
    return F.when(positive > negative, "POSITIVE").otherwise("NEGATIVE")


def confidence(positive: Column, negative: Column) -> Column:
    """The larger of both scores."""
    return F.greatest(positive, negative)


def five_class_label(probabilities: Column) -> Column:
    """Label of the largest of five probabilities, the first one on a tie."""
    best = F.array_position(probabilities, F.array_max(probabilities))
    return F.element_at(F.array(*(F.lit(x) for x in FIVE_CLASSES)), best.cast("int"))
