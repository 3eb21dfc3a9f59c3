"""Piecewise-linear trend plus yearly Fourier season by ridge regression."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.operators.calendar import month_starts_ahead
from fluxloom.operators.cleaning import min_rows_per_key
from fluxloom.operators.linalg import FIT_COLUMNS, dot, fit_designs, ridge_rows, with_intercept
from fluxloom.plans.common import FITS, HORIZON, finish_forecast, register_model, training_window

CHANGE_POINTS = 25
TREND_SHARE = 0.8
HARMONICS = 10
YEAR_DAYS = 365.25


def additive_design(date: Column, first: Column, last: Column) -> Column:
    """Scaled time, hinges at change points over the first 80 % of the history, Fourier pairs."""
    t = F.datediff(date, first) / F.greatest(F.datediff(last, first), F.lit(1))
    knots = F.transform(F.sequence(F.lit(1), F.lit(CHANGE_POINTS)), lambda j: j * (TREND_SHARE / CHANGE_POINTS))
    hinges = F.transform(knots, lambda s: F.greatest(t - s, F.lit(0.0)))
    angle = F.unix_date(date) * (2 * math.pi / YEAR_DAYS)
    waves = F.flatten(
        F.transform(F.sequence(F.lit(1), F.lit(HARMONICS)), lambda k: F.array(F.sin(angle * k), F.cos(angle * k)))
    )
    return F.concat(F.array(t), hinges, waves)


def additive_samples(monthly: DataFrame, issues: DataFrame, least: int = 5) -> DataFrame:
    rows = min_rows_per_key(training_window(monthly, issues), FITS, "observation", least)
    w = Window.partitionBy(*FITS)
    spans = rows.withColumns({"first": F.min("datetime").over(w), "last": F.max("datetime").over(w)})
    return spans.withColumn("x", additive_design(F.col("datetime"), F.col("first"), F.col("last")))


def _design(dates: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows (1, x, y) of one series, x as in ``additive_design``; dates are days since 1970."""
    t = (dates - dates.min()) / max(dates.max() - dates.min(), 1)
    knots = np.arange(1, CHANGE_POINTS + 1) * (TREND_SHARE / CHANGE_POINTS)
    angle = np.outer(dates * (2 * math.pi / YEAR_DAYS), np.arange(1, HARMONICS + 1))
    waves = np.stack([np.sin(angle), np.cos(angle)], axis=2).reshape(len(t), -1)
    return np.column_stack([np.ones(len(t)), t, np.maximum(t[:, None] - knots, 0.0), waves, y])


def additive_fit(monthly: DataFrame, issues: DataFrame, ridge: float = 1.0) -> DataFrame:
    """One fit per series and issue date, with its first and last date. A series travels packed: it is bounded."""
    rows = min_rows_per_key(training_window(monthly, issues), FITS, "observation", 5).where("observation is not null")
    packed = rows.groupBy(*FITS).agg(
        F.min("datetime").alias("first"), F.max("datetime").alias("last"),
        F.sort_array(F.collect_list(F.struct(F.unix_date("datetime").alias("d"), "observation"))).alias("s"),
    )
    packed = packed.select(*FITS, "first", "last", F.col("s.d").alias("d"), F.col("s.observation").alias("y"))
    carried = [*FITS, "first", "last"]
    types = dict(packed.dtypes)

    def run(batches):
        for pdf in batches:
            designs = [_design(np.asarray(d, float), np.asarray(y, float)) for d, y in zip(pdf["d"], pdf["y"])]
            yield pd.concat([pdf[carried].reset_index(drop=True), pd.DataFrame(fit_designs(designs, ridge_rows(ridge)), dtype=object)], axis=1)

    return packed.mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in carried) + ", " + FIT_COLUMNS)


@register_model("prophet")
def fc_additive(monthly: DataFrame, drivers, issues: DataFrame, horizon: int = HORIZON, ridge: float = 1.0) -> DataFrame:
    """Month starts up to ``horizon`` months past the issue date; sigma is the residual spread."""
    fits = additive_fit(monthly, issues, ridge)
    ahead = month_starts_ahead(F.col("last"), F.col("issue"), horizon)
    rows = fits.withColumn("datetime", F.explode(ahead))
    x = additive_design(F.col("datetime"), F.col("first"), F.col("last"))
    return finish_forecast(
        rows.select(
            *FITS, "datetime", dot(F.col("coef"), with_intercept(x)).alias("mu"),
            F.col("residual_sd").alias("sigma"), "error",
        ),
        "prophet",
    )
