"""Exponential smoothing by grid search: all series of a batch and all grid points are folded month by month at once."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.dates import steps_to_issue
from fluxloom.operators.isolate import isolated
from fluxloom.plans.common import (
    BAND_68, FITS, HORIZON, finish_forecast, register_model, series_arrays, training_series,
)

SEASON = 12
LEVELS = (0.05, 0.2, 0.4, 0.6, 0.8)
TRENDS = ((0.0, 0.0), (0.1, 0.9), (0.1, 0.98))  # (trend weight, damping); zero is no trend
SEASONS = (0.0, 0.05, 0.2, 0.5)  # zero is no season


def parameter_grid() -> list[tuple[float, float, float, float, int]]:
    """(level, trend, damping, season weight, parameters counted with initial states)."""
    grid = []
    for a, (b, phi), g in product(LEVELS, TRENDS, SEASONS):
        grid.append((a, b, phi, g, 2 + (3 if phi else 0) + (SEASON if g else 0)))
    return grid


#: Series folded at once: the states of one take some kilobytes.
STEP = 2000
STATES = (
    "aicc double, p struct<a:double,b:double,phi:double,g:double,np:int>, "
    "end struct<l:double,t:double,s:array<double>,sse:double>, error string"
)


def fold_grid(series: list[np.ndarray], grid) -> list[tuple[float, dict, dict] | None]:
    """Best grid point of each series by AICc and its final state: one pass over months for all series and points."""
    a, b, phi, g, count = (np.array(x, float) for x in zip(*grid))
    n = np.array([len(y) for y in series])
    y = np.zeros((len(series), int(n.max(initial=0))))
    for i, values in enumerate(series):
        y[i, : len(values)] = values
    long = n >= 2 * SEASON
    m1 = np.array([np.mean(v[:SEASON]) for v in series])
    m2 = np.array([np.mean(v[SEASON : 2 * SEASON]) if k else np.nan for v, k in zip(series, long)])
    slope = np.where(long, (m2 - m1) / SEASON, 0.0)
    trend = np.where(phi > 0, slope[:, None], 0.0)
    level = m1[:, None] - 6.5 * trend
    season = np.zeros((len(series), len(grid), SEASON))
    for i in np.flatnonzero(long):
        season[i, g > 0] = (series[i][:SEASON] - m1[i] + series[i][SEASON : 2 * SEASON] - m2[i]) / 2
    sse = np.zeros_like(level)
    for t in range(y.shape[1]):
        on = (t < n)[:, None]
        now = season[:, :, t % SEASON]
        base = level + phi * trend
        e = y[:, t, None] - base - now
        level = np.where(on, base + a * e, level)
        trend = np.where(on, phi * trend + b * e, trend)
        season[:, :, t % SEASON] = np.where(on, now + g * e, now)
        sse = np.where(on, sse + e * e, sse)
    k = count + 1
    spare = n[:, None] - k - 1
    usable = (spare > 0) & ((g == 0) | long[:, None]) & (sse > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        aicc = np.where(usable, n[:, None] * np.log(sse) + 2 * k + 2 * k * (k + 1) / spare, np.inf)
    out = []
    for i, best in enumerate(aicc.argmin(axis=1)):
        if not np.isfinite(aicc[i, best]):
            out.append(None)
            continue
        point = dict(zip(("a", "b", "phi", "g"), map(float, grid[best][:4])), np=int(grid[best][4]))
        state = np.roll(season[i, best], -(n[i] % SEASON)).tolist()
        end = {"l": float(level[i, best]), "t": float(trend[i, best]), "s": state, "sse": float(sse[i, best])}
        out.append((float(aicc[i, best]), point, end))
    return out


def ets_states(fits: DataFrame, grid=None) -> DataFrame:
    """The best parameter point of each series by AICc, with its final level, trend and season.

    Start values come from the first one or two years. Seasonal forms need two years. Series without a
    usable point give no row; one that fails gives a row with the message in ``error``.
    """
    grid = grid or parameter_grid()
    carried = [c for c in fits.columns if c != "y"]
    types = dict(fits.dtypes)

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), STEP):
                part = pdf.iloc[at : at + STEP].reset_index(drop=True)
                series = list(part["y"])
                found, errors = isolated(lambda at, s=series: fold_grid([np.asarray(s[i], float) for i in at], grid), len(series))
                values = pd.Series([(*(f or [None] * 3), e) if f or e else None for f, e in zip(found, errors)], dtype=object)
                some = values.notna()
                best = pd.DataFrame(values[some].tolist(), columns=["aicc", "p", "end", "error"], dtype=object)
                yield pd.concat([part.loc[some, carried].reset_index(drop=True), best], axis=1)

    return fits.mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in carried) + ", " + STATES)


@register_model("ets")
def fc_ets(monthly: DataFrame, drivers, issues: DataFrame, horizon: int = HORIZON, grid=None) -> DataFrame:
    """Additive-error smoothing; sigma is the half width of the 68 % band."""
    best = ets_states(series_arrays(training_series(monthly, issues)), grid)
    steps = F.sequence(F.lit(1), steps_to_issue(F.col("last"), F.col("issue"), horizon))
    p, end = F.col("p"), F.col("end")
    damped = lambda j: F.when(p.phi > 0, p.phi * (1 - F.pow(p.phi, j)) / (1 - p.phi)).otherwise(F.lit(0.0))
    response = lambda i: p.a + p.b * damped(i) + F.when(i % SEASON == 0, p.g).otherwise(F.lit(0.0))
    earlier = lambda j: F.when(j > 1, F.sequence(F.lit(1), j - 1)).otherwise(F.array().cast("array<int>"))
    spread = lambda j: F.aggregate(earlier(j), F.lit(1.0), lambda s, i: s + response(i) * response(i))
    noise = F.try_divide(end.sse, F.col("size") - p.np)
    rows = best.select(
        *FITS, "last", "p", "end", "error", noise.alias("noise"), F.explode(steps).alias("j")
    )
    j = F.col("j")
    return finish_forecast(
        rows.select(
            *FITS,
            F.add_months("last", j).alias("datetime"),
            (end.l + damped(j) * end.t + F.get(end.s, (j - 1) % SEASON)).alias("mu"),
            (BAND_68 * F.sqrt(F.col("noise") * spread(j))).alias("sigma"),
            "error",
        ),
        "ets",
    )
