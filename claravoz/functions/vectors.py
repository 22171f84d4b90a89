"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector scaled to length one; a zero vector stays as it is.

    The length is computed once, in the fold, and used in its last step.
    """
    return F.aggregate(
        v,
        F.lit(0.0),
        lambda acc, x: acc + x.cast("double") * x.cast("double"),
        lambda acc: F.transform(
            v, lambda x: F.when(acc == 0, x.cast("double")).otherwise(x.cast("double") / F.sqrt(acc))
        ),
    )
