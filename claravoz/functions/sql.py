"""The scalar helpers as SQL functions.

They are registered as SQL expressions, so a call is inlined into the plan
and the optimiser sees through it; there is no Python at run time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from claravoz.functions import dates, scoring, text

SQL_FUNCTIONS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "clean_strip": ("STRING", text.strip),
    "clean_boolean": ("BOOLEAN", text.normalize_boolean),
    "clean_date": ("DATE", dates.parse_date),
    "clean_markup": ("STRING", text.sanitize_markup),
    "clean_text": ("STRING", lambda c: text.sanitize_text(c, excel_safe=True)),
    "clean_formula": ("STRING", text.escape_formula),
    "clean_file_name": ("STRING", text.safe_file_name),
    "is_dangerous_formula": ("BOOLEAN", text.has_dangerous_formula),
    "attack_classes": ("ARRAY<STRING>", text.attack_classes),
    "pain_points_of": ("ARRAY<STRING>", text.extract_pain_points),
    "severity_level": ("STRING", scoring.severity_level),
}


def _rendered(spark: SparkSession, make: Callable[[Column], Column], data_type: str) -> str:
    """SQL text of an expression over a parameter ``x``."""
    one = spark.range(1).select(F.lit(None).cast(data_type).alias("x"))
    plan = one.select(make(F.col("x")).alias("r"))._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql()


def register(spark: SparkSession) -> list[str]:
    """Create every function as a temporary function of the session; returns the names."""
    for name, (returns, make) in SQL_FUNCTIONS.items():
        takes = "DOUBLE" if name == "severity_level" else "STRING"
        body = _rendered(spark, make, takes)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x {takes}) RETURNS {returns} RETURN {body}")
    return list(SQL_FUNCTIONS)
