"""Scalar column expressions; all JVM-side."""

from claravoz.functions import dates, scoring, text, vectors

__all__ = ["dates", "scoring", "text", "vectors"]
