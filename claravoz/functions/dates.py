"""Dates written in many formats."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claravoz.functions.text import BLANK_CLASS, script_strip

_D = r"(?:0?[1-9]|[12]\d|3[01])"
_M = r"(?:0?[1-9]|1[0-2])"
_TIME = rf"[{BLANK_CLASS}]+(?:2[0-3]|[01]?\d):[0-5]?\d:[0-5]?\d"
_MONTH_NAME = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"


class DateFormat(NamedTuple):
    """A written date: its shape, and the pattern that reads the date part."""

    name: str
    shape: str
    pattern: str
    timed: bool = False
    short_year: bool = False


# Accepted formats.
_ALL = {
    f.name: f
    for f in (
        DateFormat("Y-m-d", rf"^\d{{4}}-{_M}-{_D}$", "yyyy-M-d"),
        DateFormat("Y/m/d", rf"^\d{{4}}/{_M}/{_D}$", "yyyy/M/d"),
        DateFormat("d/m/Y", rf"^{_D}/{_M}/\d{{4}}$", "d/M/yyyy"),
        DateFormat("m/d/Y", rf"^{_M}/{_D}/\d{{4}}$", "M/d/yyyy"),
        DateFormat("d-m-Y", rf"^{_D}-{_M}-\d{{4}}$", "d-M-yyyy"),
        DateFormat("m-d-Y", rf"^{_M}-{_D}-\d{{4}}$", "M-d-yyyy"),
        DateFormat("Y-m-d time", rf"^\d{{4}}-{_M}-{_D}{_TIME}$", "yyyy-M-d", timed=True),
        DateFormat("d/m/Y time", rf"^{_D}/{_M}/\d{{4}}{_TIME}$", "d/M/yyyy", timed=True),
        DateFormat("m/d/Y time", rf"^{_M}/{_D}/\d{{4}}{_TIME}$", "M/d/yyyy", timed=True),
        DateFormat("y-m-d", rf"^\d\d-{_M}-{_D}$", "yy-M-d", short_year=True),
        DateFormat("d/m/y", rf"^{_D}/{_M}/\d\d$", "d/M/yy", short_year=True),
        DateFormat("m/d/y", rf"^{_M}/{_D}/\d\d$", "M/d/yy", short_year=True),
        DateFormat("d-m-y", rf"^{_D}-{_M}-\d\d$", "d-M-yy", short_year=True),
        DateFormat("m-d-y", rf"^{_M}-{_D}-\d\d$", "M-d-yy", short_year=True),
        DateFormat("d.m.Y", rf"^{_D}\.{_M}\.\d{{4}}$", "d.M.yyyy"),
        DateFormat("d-b-Y", rf"(?i)^{_D}-{_MONTH_NAME}-\d{{4}}$", "d-MMM-yyyy"),
    )
}

# The twelve general formats, tried in this order (day before month).
GENERAL_FORMATS = (
    "Y-m-d", "Y/m/d", "d/m/Y", "m/d/Y", "d-m-Y", "m-d-Y",
    "Y-m-d time", "d/m/Y time", "m/d/Y time", "y-m-d", "d/m/y", "m/d/y",
)
# The formats of the survey file, in its own order.
SURVEY_FORMATS = ("Y-m-d", "d-m-y", "m-d-y", "d/m/Y", "m/d/Y", "Y/m/d", "d.m.Y", "d-b-Y")
# General formats followed by those only the survey file has.
EXTENDED_FORMATS = (*GENERAL_FORMATS, "d-m-y", "m-d-y", "d.m.Y", "d-b-Y")


def _read(text: Column, fmt: DateFormat) -> Column:
    """Date under one format; null for other shapes and impossible days.

    The shape check comes first, so the parser is called on text it can read
    and does not raise and catch an error per row and format.
    """
    day_part = F.regexp_replace(text, rf"[{BLANK_CLASS}].*$", "") if fmt.timed else text
    day = F.try_to_date(day_part, fmt.pattern)
    if fmt.short_year:
        # two-digit years 69..99 belong to the last century
        day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
    return F.when(text.rlike(fmt.shape), day)


def parse_date(c: Column, formats: Sequence[str] = GENERAL_FORMATS,
               data_type: T.DataType | None = None, stripped: bool = False) -> Column:
    """Date of the first format that fits, else null; a time part is dropped.

    Text that does not start like a date costs one pattern. Year-first and
    day- or month-first shapes exclude each other, so only one of the two
    groups is tried, each in the given order.
    """
    if isinstance(data_type, T.DateType | T.TimestampType | T.TimestampNTZType):
        return c.cast("date")
    if data_type is not None and not isinstance(data_type, T.StringType):
        return F.lit(None).cast("date")
    text = c if stripped else script_strip(c)
    year_first = [_read(text, _ALL[name]) for name in formats if name.startswith("Y")]
    day_first = [_read(text, _ALL[name]) for name in formats if not name.startswith("Y")]
    return (
        F.when(text.rlike(r"^\d{4}[-/]"), F.coalesce(F.lit(None).cast("date"), *year_first))
        .when(text.rlike(r"^\d\d?[-/.]"), F.coalesce(F.lit(None).cast("date"), *day_first))
    )


def iso_date(c: Column, formats: Sequence[str] = GENERAL_FORMATS,
             data_type: T.DataType | None = None, stripped: bool = False) -> Column:
    """The same as text, ``yyyy-MM-dd``."""
    return F.date_format(parse_date(c, formats, data_type, stripped), "yyyy-MM-dd")


def date_format_name(c: Column, formats: Sequence[str] = EXTENDED_FORMATS) -> Column:
    """Name of the first format whose shape fits, else ``other``; null stays null."""
    text = script_strip(c)
    label = F.when(text.isNull(), F.lit(None).cast("string"))
    for name in formats:
        label = label.when(text.rlike(_ALL[name].shape), F.lit(name))
    return label.otherwise(F.lit("other"))


def version_stamp(ts: Column | None = None) -> Column:
    """Schema version: ``yyyyMMddHHmmss`` in UTC (the session time zone must be UTC)."""
    return F.date_format(F.current_timestamp() if ts is None else ts, "yyyyMMddHHmmss")
