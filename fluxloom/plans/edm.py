"""Empirical dynamic modelling: simplex projection to choose the dimension, S-map to forecast."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.dates import steps_to_issue
from fluxloom.operators.linalg import FIT_COLUMNS, dot, fit_designs, with_intercept
from fluxloom.operators.series import argmax_by
from fluxloom.session import staged
from fluxloom.plans.common import FITS, HORIZON, finish_forecast, register_model, series_arrays, training_series

MAX_E = 12
STEPS_AHEAD = 6
LIBRARY_SHARE = 0.8


def _skill(y: np.ndarray, lib: int, max_e: int, tp: int) -> list[tuple[int, float | None, int]]:
    """(E, correlation, points) of one series. Distances grow by one squared term per dimension."""
    out = []
    targets, pool = np.arange(lib + 1, len(y) - tp + 1), np.arange(1, lib - tp + 1)
    squares = np.zeros((len(targets), len(pool)))
    for e in range(1, max_e + 1):
        targets_in, pool_in = targets >= e, pool >= e
        targets, pool, squares = targets[targets_in], pool[pool_in], squares[targets_in][:, pool_in]
        if not len(targets) or not len(pool):
            break
        squares = squares + (y[targets - e][:, None] - y[pool - e]) ** 2
        d = np.sqrt(squares)
        near = np.argsort(d, axis=1, kind="stable")[:, : e + 1]
        d = np.take_along_axis(d, near, axis=1)
        first = d[:, :1]
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(first > 0, np.maximum(np.exp(-d / first), 1e-6), np.where(d > 0, 1e-6, 1.0))
        predicted = (weight * y[pool[near] + tp - 1]).sum(axis=1) / weight.sum(axis=1)
        truth = y[targets + tp - 1]
        a, b = predicted - predicted.mean(), truth - truth.mean()
        scale = math.sqrt(float(a @ a) * float(b @ b))
        out.append((e, float(a @ b) / scale if scale > 0 else None, len(targets)))
    return out


def simplex_skill(arrays: DataFrame, max_e: int = MAX_E, tp: int = STEPS_AHEAD) -> DataFrame:
    """Correlation of simplex predictions with the truth per series and embedding dimension.

    The first 80 % of a series is the library. A point of the rest is predicted from its E + 1
    nearest library points (earlier date on a tie), weighted by exp(-d / nearest d), at least 1e-6.
    Only one bounded series is in memory at a time.
    """
    lib = F.bround(F.col("size") * LIBRARY_SHARE, 0).cast("int")
    series = arrays.select(*FITS, "y", lib.alias("lib"))
    types = dict(series.dtypes)

    def run(batches):
        for pdf in batches:
            found = [_skill(np.asarray(y, float), lib, max_e, tp) for y, lib in zip(pdf["y"], pdf["lib"])]
            keys = pdf.loc[pdf.index.repeat([len(f) for f in found]), list(FITS)].reset_index(drop=True)
            rows = pd.DataFrame([r for f in found for r in f], columns=["E", "rho", "points"], dtype=object)
            yield pd.concat([keys, rows], axis=1)

    return series.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in FITS) + ", E int, rho double, points long")


def edm_select_dimension(monthly: DataFrame, issues: DataFrame) -> DataFrame:
    """Embedding dimension of highest skill per series and issue date."""
    skill = simplex_skill(series_arrays(training_series(monthly, issues)))
    return argmax_by(skill, FITS, "E", "rho")


def smap_fit(monthly: DataFrame, issues: DataFrame) -> DataFrame:
    """Global linear map from the chosen number of lags to the next month."""
    arrays = staged(series_arrays(training_series(monthly, issues)), "series")
    chosen = argmax_by(simplex_skill(arrays), FITS, "E", "rho").drop("rho")
    fits = arrays.join(chosen, list(FITS)).where(F.col("size") > F.col("E"))
    types = dict(fits.dtypes)

    def lags(y: np.ndarray, e: int) -> np.ndarray:
        """Rows (1, newest to oldest of e values, next value)."""
        return np.column_stack([np.ones(len(y) - e), *[y[e - i : len(y) - i] for i in range(1, e + 1)], y[e:]])

    def run(batches):
        for pdf in batches:
            designs = [lags(np.asarray(y, float), e) for y, e in zip(pdf["y"], pdf["E"])]
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(fit_designs(designs), dtype=object)], axis=1)

    return fits.mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in fits.columns) + ", " + FIT_COLUMNS)


@register_model("rEDM")
def fc_smap(monthly: DataFrame, drivers, issues: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Iterated one-month maps; sigma is the residual spread of the map."""
    fits = smap_fit(monthly, issues).withColumn("h", steps_to_issue(F.col("last"), F.col("issue"), horizon))
    state = F.reverse(F.slice("y", F.col("size") - F.col("E") + 1, F.col("E")))
    # The state keeps the newest value first and never shrinks: the first h entries are the forecast.
    path = F.aggregate(
        F.sequence(F.lit(1), F.col("h")),
        state,
        lambda s, _: F.concat(F.array(dot(F.col("coef"), with_intercept(F.slice(s, 1, F.col("E"))))), s),
    )
    ahead = F.slice(F.reverse(F.slice(path, 1, F.col("h"))), 1, F.col("h"))
    rows = fits.select(*FITS, "last", "residual_sd", "error", F.posexplode(ahead).alias("k", "mu"))
    return finish_forecast(
        rows.select(*FITS, F.add_months("last", F.col("k") + 1).alias("datetime"), "mu", F.col("residual_sd").alias("sigma"), "error"),
        "rEDM",
    )
