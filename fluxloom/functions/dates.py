"""Date and calendar expressions on monthly series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_mixed_date(c: Column) -> Column:
    """Month-day-year or year-month-day with ``-``, ``/``, ``.`` or blank between; else null.

    Rewritten to ISO text for the plain cast: a date format that fails on every other row would
    raise and catch an exception per row.
    """
    text = F.translate(F.trim(c), "/. ", "---")
    iso = F.regexp_replace(text, "^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})$", "$3-$1-$2")
    return F.when(iso.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), iso.try_cast("date"))


def epoch_to_date(seconds: Column) -> Column:
    """Epoch seconds to the UTC date, whatever the session zone."""
    return F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))


def month_floor(c: Column) -> Column:
    return F.trunc(c, "MM").cast("date")


def lead_to_valid_date(reference: Column, lead: Column) -> Column:
    """Valid month of a forecast issued at ``reference`` with ``lead`` months."""
    return F.add_months(reference, lead)


def date_parts(c: Column) -> dict[str, Column]:
    return {
        "year": F.year(c),
        "month": F.month(c),
        "day": F.dayofmonth(c),
        "yday": F.dayofyear(c),
        "month_text": F.date_format(c, "MM"),
    }


def pseudo_year_date(c: Column, year: int = 2024) -> Column:
    """All years laid over ``year`` by day of year."""
    return F.date_add(F.lit(f"{year}-01-01").cast("date"), F.dayofyear(c) - 1)


def horizon_months(reference: Column, valid: Column) -> Column:
    """Lead in months of 30.5 days, half rounded to even."""
    return F.bround(F.datediff(valid, reference) / F.lit(30.5)).cast("int")


def month_index(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def steps_to_issue(last: Column, issue: Column, horizon: Column | int = 6) -> Column:
    """Months from the last training month to the end of the forecast."""
    horizon = horizon if isinstance(horizon, Column) else F.lit(horizon)
    return (month_index(issue) - month_index(last) + horizon).cast("int")


def month_range(lo: Column, hi: Column) -> Column:
    """Array of month starts from ``lo`` to ``hi``; empty when ``hi`` precedes ``lo``."""
    none = F.array().cast("array<date>")
    return F.when(lo <= hi, F.sequence(lo, hi, F.expr("interval 1 month"))).otherwise(none)
