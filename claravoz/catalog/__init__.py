"""All queries, each next to the SQL it is checked against."""

from claravoz.catalog import cleaning, enrichment, files, metrics  # noqa: F401
from claravoz.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
