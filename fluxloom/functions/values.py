"""Numeric casts and small scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double_or_null(c: Column) -> Column:
    """Text to double. Not-a-number counts as missing."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def wrap_longitude(c: Column) -> Column:
    """Degrees east above 180 become negative."""
    return F.when(c > 180, c - 360).otherwise(c)


def fold_transect(c: Column) -> Column:
    return F.when(c > 3, c - 3).otherwise(c)


def rep_group_code(site: Column) -> Column:
    """Plot code without its transect digit."""
    return F.concat(F.substring(site, 1, 1), F.substring(site, 3, 1))


def ratio(a: Column, b: Column) -> Column:
    """Division that gives null, not an error, on a zero divisor."""
    return F.try_divide(a, b)


def constant(value) -> Column:
    """A nested Python constant as one literal: lists to arrays, dicts to structs.

    Written as one SQL text, since building thousands of literal columns one by one is slow.
    """

    def text(v) -> str:
        if isinstance(v, dict):
            return "named_struct(" + ", ".join(f"'{k}', {text(x)}" for k, x in v.items()) + ")"
        if isinstance(v, (list, tuple)):
            return "array(" + ", ".join(text(x) for x in v) + ")"
        return f"{float(v)!r}D" if isinstance(v, float) else str(int(v))

    return F.expr(text(value))
