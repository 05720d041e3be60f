"""Calendar arithmetic on date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.errors import InvalidRequest

UNITS = ("days", "months", "years")


def dmy_to_iso(c: Column) -> Column:
    """DD-MM-YYYY text as ISO text; text that does not parse is kept."""
    text = c.cast("string")
    parsed = F.try_to_date(text, "d-M-yyyy")
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), text)


def iso_date(c: Column) -> Column:
    """A date from ISO text, NULL for anything else (including a bare year)."""
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), c.try_cast("date"))


def check_unit(unit: str) -> str:
    """``unit`` if it is one of days, months, years."""
    if unit not in UNITS:
        raise InvalidRequest(f"unknown period unit: {unit}")
    return unit


def add_period(start: Column, value: Column, unit: Column) -> Column:
    """``start`` plus a calendar period; a short month clamps to its last day."""
    return (
        F.when(unit == "days", F.date_add(start, value))
        .when(unit == "months", F.add_months(start, value))
        .when(unit == "years", F.add_months(start, value * 12))
    )


def last_day_of_period(first: Column, value: Column, unit: Column) -> Column:
    """Last day of a period that begins on ``first``."""
    return F.date_sub(add_period(first, value, unit), 1)
