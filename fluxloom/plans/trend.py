"""Warming effect on forecast error with model and transect effects."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.labels import MODEL_NAMES
from fluxloom.operators.linalg import gram, solve_rows
from fluxloom.operators.skill import SKILL_KEYS, rmse_table


#: Share of the regressor's squares that the effects must leave.
LEAST_SHARE = 1e-9


def trend_samples(scores: DataFrame) -> DataFrame:
    """Log RMSE per series, model and transect with its indicator vector."""
    table = rmse_table(scores, by=[*SKILL_KEYS, "Transect"]).where(F.col("rmse") > 0)
    flag = lambda c, v: F.when(F.col(c) == v, F.lit(1.0)).otherwise(F.lit(0.0))
    x = F.array(
        F.col("Temp"),
        *[flag("model_id", m) for m in list(MODEL_NAMES.values())[1:]],
        *[flag("Transect", t) for t in (2, 3, 4, 5, 6)],
    )
    return table.withColumns({"x": x, "y": F.log("rmse")})


def _slope(g: np.ndarray):
    """Slope of the first regressor, its standard error and t; absent effects drop out by pseudo-inverse.

    There is no slope where the effects explain the regressor, and no error without spare rows.
    """
    n = float(g[0, 0])
    a, b = g[:-1, :-1], g[:-1, -1]
    inverse = np.linalg.pinv(a, rcond=1e-10, hermitian=True)
    coef = inverse @ b
    v = np.append(coef, -1.0)
    spare = n - np.linalg.matrix_rank(a, hermitian=True)
    gap = float(np.max(np.abs(g[:-1] @ v)) / max(np.abs(g[:-1, -1]).max(), 1e-300))
    others = np.delete(np.arange(len(a)), 1)
    own = a[1, 1] - a[1, others] @ np.linalg.pinv(a[np.ix_(others, others)], rcond=1e-10, hermitian=True) @ a[others, 1]
    if own <= LEAST_SHARE * max(a[1, 1], 1e-300):
        return n, None, None, None, gap
    if spare <= 0:
        return n, float(coef[1]), None, None, gap
    se = float(np.sqrt(max(float(v @ g @ v), 0.0) / spare * max(inverse[1, 1], 0.0)))
    return n, float(coef[1]), se, float(coef[1] / se) if se > 0 else None, gap


def _slopes(g: np.ndarray) -> tuple:
    return tuple(zip(*map(_slope, g)))


def fixed_effect_trend(scores: DataFrame) -> DataFrame:
    """Slope of log RMSE on warming per vegetation, models and transects held fixed."""
    grams = gram(trend_samples(scores), ["Veg"], F.col("x"), F.col("y"))
    return solve_rows(grams, ["Veg"], _slopes, "n double, slope double, se double, t double, gap double, error string")
