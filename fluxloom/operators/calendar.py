"""Calendar completion, gap filling and future dates.

A row of a series knows the next observed month, so it can emit the months missing in between
itself. Completion is therefore one window and one explode: no calendar table, no join, and the
partitioning by key survives for the operators that follow.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxloom.functions.dates import month_range


def _complete(df: DataFrame, keys, columns, date, lo: Column | None, hi: Column | None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(date)
    d = F.col(date)
    following = F.add_months(F.lead(date).over(w), -1)
    before = F.lag(date).over(w)
    end = F.coalesce(following, hi if hi is not None else d)
    gaps = month_range(d, F.greatest(end, d))
    if lo is not None:
        gaps = F.when(before.isNull(), F.concat(month_range(lo, F.add_months(d, -1)), gaps)).otherwise(gaps)
        gaps = F.filter(gaps, lambda m: (m == d) | ((m >= lo) & (m <= hi)))
    rows = df.select(*df.columns, gaps.alias("_months")).withColumn("_month", F.explode("_months"))
    observed = F.col("_month") == d
    return rows.select(
        *keys, F.col("_month").alias(date), *[F.when(observed, F.col(c)).alias(c) for c in columns]
    )


def complete_site_months(df: DataFrame, keys: Sequence[str], columns=("observation",), date="datetime") -> DataFrame:
    """Every month between a series' own first and last."""
    return _complete(df, keys, columns, date, None, None)


def complete_global_months(df: DataFrame, keys: Sequence[str], columns=("observation",), date="datetime") -> DataFrame:
    """Every month between the first and last of the whole table, for every series."""
    ends = df.agg(F.struct(F.min(date).alias("lo"), F.max(date).alias("hi"))).scalar()
    bounded = df.withColumn("_ends", ends)
    return _complete(bounded, keys, columns, date, F.col("_ends.lo"), F.col("_ends.hi"))


def complete_fixed_months(
    df: DataFrame, keys: Sequence[str], y0: int, y1: int, columns=("observation",), date="datetime"
) -> DataFrame:
    """A fixed grid of years for every series; rows outside the grid stay, their gaps do not."""
    lo, hi = F.lit(dt.date(y0, 1, 1)), F.lit(dt.date(y1, 12, 1))
    return _complete(df, keys, columns, date, lo, hi)


def fill_month_mean(df: DataFrame, keys: Sequence[str], column="observation", date="datetime") -> DataFrame:
    """A missing value becomes the mean of its calendar month in the same series."""
    w = Window.partitionBy(*keys, F.month(date))
    return df.withColumn(column, F.coalesce(F.col(column), F.avg(column).over(w)))


def interpolate_linear(df: DataFrame, keys: Sequence[str], order: str, column: str) -> DataFrame:
    """Linear between known neighbours by position; ends repeat the nearest known value."""
    w = Window.partitionBy(*keys).orderBy(order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(column).alias("v")))
    out = (
        df.withColumn("_pos", F.row_number().over(w))
        .withColumn("_a", F.last(known, ignorenulls=True).over(back))
        .withColumn("_b", F.first(known, ignorenulls=True).over(ahead))
    )
    a, b = F.col("_a"), F.col("_b")
    share = (F.col("_pos") - a.p) / (b.p - a.p)
    value = (
        F.when(F.col(column).isNotNull(), F.col(column))
        .when(a.isNull(), b.v)
        .when(b.isNull(), a.v)
        .otherwise(a.v + (b.v - a.v) * share)
    )
    return out.withColumn(column, value).drop("_pos", "_a", "_b")


def filled_series(monthly: DataFrame, keys: Sequence[str], column="observation") -> DataFrame:
    """Complete calendar, month-mean fill, then linear interpolation."""
    full = complete_site_months(monthly.select(*keys, "datetime", column), keys, [column])
    return interpolate_linear(fill_month_mean(full, keys, column), keys, "datetime", column)


def future_months(df: DataFrame, keys: Sequence[str], h: Column | int, date="datetime") -> DataFrame:
    """The ``h`` months after each series' last, numbered by ``step``."""
    h = h if isinstance(h, Column) else F.lit(h)
    last = df.groupBy(*keys).agg(F.max(date).alias("_last"))
    steps = last.select(*keys, "_last", F.explode(F.sequence(F.lit(1), h)).alias("step"))
    return steps.select(*keys, "step", F.add_months("_last", F.col("step")).alias(date))


def month_starts_ahead(last: Column, issue: Column, horizon: int = 6) -> Column:
    """Firsts of month among the days after ``last`` up to ``horizon`` months past the issue date."""
    days = F.sequence(F.date_add(last, 1), F.add_months(issue, horizon), F.expr("interval 1 day"))
    return F.filter(days, lambda d: F.dayofmonth(d) == 1)


def future_days_month_starts(df: DataFrame, keys: Sequence[str], issue: Column, horizon: int = 6, date="datetime"):
    """The month starts ahead of each series, one row each."""
    last = df.groupBy(*keys).agg(F.max(date).alias("_last"))
    return last.select(*keys, F.explode(month_starts_ahead(F.col("_last"), issue, horizon)).alias(date))


def issue_calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """Monthly issue dates, both ends floored to the first of the month."""
    floor = lambda d: F.lit(d.replace(day=1))
    return spark.range(1).select(F.explode(month_range(floor(start), floor(end))).alias("issue"))
