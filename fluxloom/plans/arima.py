"""Seasonal ARIMA by two-stage regression (Hannan and Rissanen 1982) on one Gram matrix per series."""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.functions.dates import steps_to_issue
from fluxloom.functions.labels import coefficient_base, coefficient_type
from fluxloom.operators.calendar import complete_site_months, fill_month_mean, interpolate_linear
from fluxloom.operators.cleaning import min_rows_per_key
from fluxloom.operators.linalg import dot, gram, gram_fit, ridge_solve, solve_rows, with_intercept
from fluxloom.session import staged
from fluxloom.plans.common import BAND_68, FITS, HORIZON, finish_forecast, register_model, training_window

SEASON = 12
LONG_AR = 6
MAX_AR, MAX_MA, MAX_SAR, MAX_SMA = 5, 2, 1, 1
#: Order of the coefficients of every fit; terms outside the chosen order are zero.
TERMS = ("drift", "ar1", "ar2", "ar3", "ar4", "ar5", "sar1", "ma1", "ma2", "sma1")
ORDERS = tuple(product(range(MAX_AR + 1), range(MAX_MA + 1), range(MAX_SAR + 1), range(MAX_SMA + 1)))
ORDER_COLUMNS = "n double, coef array<double>, rss double, aicc double, noise double, p int, q int, sp int, sq int, error string"


def _terms(p: int, q: int, sp: int, sq: int) -> list[int]:
    return [0, *range(1, 1 + p), *range(6, 6 + sp), *range(7, 7 + q), *range(9, 9 + sq)]


def choose_orders(g: np.ndarray) -> tuple:
    """Order of lowest AICc for each matrix of a stack. Every candidate is a sub-matrix, so all use the same rows."""
    n, last = g[:, 0, 0], g.shape[1] - 1
    best = np.full(len(g), np.inf)
    coef, rss, noise = np.zeros((len(g), len(TERMS))), np.zeros(len(g)), np.zeros(len(g))
    chosen = np.full(len(g), -1)
    for i, order in enumerate(ORDERS):
        used = _terms(*order)
        k = len(used) + 1
        at = np.flatnonzero(n - k - 1 > 0)
        if not len(at):
            continue
        sub = g[at][:, [*used, last]][:, :, [*used, last]]
        b = ridge_solve(sub, np.zeros(len(at)))
        v = np.concatenate([b, -np.ones((len(at), 1))], axis=1)
        left = np.maximum(np.einsum("mi,mij,mj->m", v, sub, v), 1e-12)
        aicc = n[at] * np.log(left / n[at]) + 2 * k + 2 * k * (k + 1) / (n[at] - k - 1)
        better = aicc < best[at] - 1e-9
        at = at[better]
        best[at], rss[at], chosen[at] = aicc[better], left[better], i
        noise[at] = left[better] / np.maximum(n[at] - len(used), 1)
        coef[at] = 0.0
        coef[np.ix_(at, used)] = b[better]
    found = chosen >= 0
    show = lambda values: [x if ok else None for x, ok in zip(values, found)]
    orders = [show([ORDERS[i][j] for i in chosen]) for j in range(4)]
    return (n, show(coef.tolist()), show(rss.tolist()), show(best.tolist()), show(noise.tolist()), *orders)


def _present(*columns: str):
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def arima_rows(monthly: DataFrame, issues: DataFrame, least: int = 5) -> DataFrame:
    """Calendar-complete rows with the seasonal difference ``w`` and its long-autoregression residual ``e``."""
    rows = min_rows_per_key(training_window(monthly, issues), FITS, "observation", least)
    full = complete_site_months(rows.select(*FITS, "datetime", "observation"), FITS)
    full = fill_month_mean(full.withColumn("filled", F.col("observation")), FITS, "filled")
    full = interpolate_linear(full, FITS, "datetime", "filled")
    w = Window.partitionBy(*FITS).orderBy("datetime")
    diff = full.withColumn("w", F.col("observation") - F.lag("observation", SEASON).over(w))
    names = [f"lag{i}" for i in range(1, LONG_AR + 1)]
    lagged = diff.withColumns({n: F.lag("w", i).over(w) for i, n in enumerate(names, start=1)})
    whole = _present("w", *names)
    fit = gram_fit(lagged.where(whole), FITS, [F.col(n) for n in names], F.col("w"))
    first = fit.select(*FITS, F.col("coef").alias("long_ar"))
    return (
        lagged.join(first, list(FITS), "left")
        .withColumn("e", F.when(whole, F.col("w") - dot(F.col("long_ar"), with_intercept(F.array(*names)))))
        .drop(*names, "long_ar")
    )


#: Lags behind the terms after the drift: differences one to five and a season back, residuals one, two and a season back.
LAGS = {f"{c}{k}": (c, k) for c, ks in (("w", (*range(1, MAX_AR + 1), SEASON)), ("e", (*range(1, MAX_MA + 1), SEASON))) for k in ks}


def arima_samples(rows: DataFrame) -> DataFrame:
    """Rows that have every lag, with a column per lag."""
    w = Window.partitionBy(*FITS).orderBy("datetime")
    return rows.withColumns({n: F.lag(c, k).over(w) for n, (c, k) in LAGS.items()}).where(_present("w", *LAGS))


def arima_orders(rows: DataFrame) -> DataFrame:
    """Chosen order and coefficients per fit, from rows that have every lag; ``n`` counts them."""
    g = gram(arima_samples(rows), FITS, [F.col(n) for n in LAGS], F.col("w"))
    return solve_rows(g, FITS, choose_orders, ORDER_COLUMNS)


def arima_fits(monthly: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per fit: coefficients and the newest values, newest first.

    A series too short for any order keeps zero coefficients: the seasonal naive forecast.
    """
    # Read by the order search and for the newest values: written once, so the first stage fits once.
    rows = staged(arima_rows(monthly, issues), "arima-rows")
    newest = F.reverse(F.sort_array(F.collect_list(F.struct("datetime", "filled", "w", "e"))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    tails = rows.groupBy(*FITS).agg(
        newest.alias("_t"), F.max("datetime").alias("last"), F.coalesce(F.var_samp("w"), F.var_samp("filled")).alias("w_var"),
    )
    pad = F.array_repeat(F.lit(0.0), SEASON)
    tails = tails.select(
        *FITS, "last", "w_var",
        F.concat(F.transform("_t", lambda t: zero(t.filled)), pad).alias("y"),
        F.concat(F.transform("_t", lambda t: zero(t.w)), pad).alias("w"),
        F.concat(F.transform("_t", lambda t: zero(t.e)), pad).alias("e"),
    )
    flat = F.array_repeat(F.lit(0.0), len(TERMS))
    return tails.join(arima_orders(rows), list(FITS), "left").withColumns(
        {"coef": F.coalesce("coef", flat), "noise": F.coalesce("noise", "w_var")}
    )


@register_model("auto.arima")
def fc_arima(monthly: DataFrame, drivers, issues: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Recursion of the chosen model; sigma from its impulse response, as a 68 % half width."""
    fits = arima_fits(monthly, issues).withColumn("h", steps_to_issue(F.col("last"), F.col("issue"), horizon))
    c = lambda i: F.get("coef", F.lit(i))
    ar, ma = F.slice("coef", 2, MAX_AR), F.slice("coef", 8, MAX_MA)
    season = F.lit(SEASON - 1)

    def step(s, _):
        w = (
            c(0) + dot(ar, F.slice(s.w, 1, MAX_AR)) + c(6) * F.get(s.w, season)
            + dot(ma, F.slice(s.e, 1, MAX_MA)) + c(9) * F.get(s.e, season)
        )
        grow = lambda v, tail: F.concat(F.array(v), tail)
        return F.struct(
            grow(w, s.w).alias("w"), grow(F.lit(0.0), s.e).alias("e"),
            grow(w + F.get(s.y, season), s.y).alias("y"),
        )

    start = F.struct("w", "e", "y")
    path = F.aggregate(F.sequence(F.lit(1), F.col("h")), start, step).y
    impulse = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), SEASON))

    def respond(s, k):
        w = (
            dot(ar, F.slice(s.w, 1, MAX_AR)) + c(6) * F.get(s.w, season)
            + F.when(k <= MAX_MA, F.get(ma, k - 1)).otherwise(F.lit(0.0))
            + F.when(k == SEASON, c(9)).otherwise(F.lit(0.0))
        )
        return F.struct(
            F.concat(F.array(w), s.w).alias("w"), F.concat(F.array(w + F.get(s.y, season)), s.y).alias("y")
        )

    unit = F.struct(impulse.alias("w"), impulse.alias("y"))
    response = F.aggregate(F.sequence(F.lit(1), F.col("h")), unit, respond).y
    # Newest first: entry h - k of the response belongs to lag k.
    order = lambda xs: F.reverse(F.slice(xs, 1, F.col("h")))
    rows = fits.select(
        *FITS, "last", "noise", "error",
        order(path).alias("mu"),
        F.reverse(F.slice(response, 2, F.col("h"))).alias("psi"),
    )
    rows = rows.select(*FITS, "last", "noise", "error", "psi", F.posexplode("mu").alias("k", "mu"))
    spread = F.aggregate(F.slice("psi", 1, F.col("k") + 1), F.lit(0.0), lambda s, v: s + v * v)
    return finish_forecast(
        rows.select(
            *FITS, F.add_months("last", F.col("k") + 1).alias("datetime"), "mu",
            (BAND_68 * F.sqrt(F.col("noise") * spread)).alias("sigma"), "error",
        ),
        "auto.arima",
    )


def arima_coefficients(monthly: DataFrame, issues: DataFrame) -> DataFrame:
    """Coefficients of each fit as rows; terms outside the chosen order are null."""
    fits = arima_fits(monthly, issues).where(F.col("p").isNotNull())
    inside = [
        F.lit(True), *[F.col("p") >= i for i in range(1, 6)], F.col("sp") >= 1,
        *[F.col("q") >= i for i in (1, 2)], F.col("sq") >= 1,
    ]
    cells = F.array(
        *[F.struct(F.lit(t).alias("name"), F.when(ok, F.get("coef", F.lit(i))).alias("value"))
          for i, (t, ok) in enumerate(zip(TERMS, inside))]
    )
    return fits.select(*FITS, F.explode(cells).alias("c")).select(
        *FITS,
        coefficient_base(F.col("c.name")).alias("name"),
        coefficient_type(F.col("c.name")).alias("Type"),
        F.col("c.value").alias("value"),
    )
