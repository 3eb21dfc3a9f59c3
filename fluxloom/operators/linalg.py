"""Keyed least squares from Gram matrices.

Everything that grows with the data is a Spark aggregation of products, combined on the map side,
so one key may hold any share of the rows. What reaches Python is one packed k x k matrix per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.operators.isolate import isolated

#: Of a fit that failed all is null but the message.
FIT_COLUMNS = "n double, coef array<double>, rss double, residual_sd double, gap double, error string"


#: Most regressors summed as separate aggregate columns; more than these go one cell per row.
WIDE_LIMIT = 12


def gram(
    df: DataFrame,
    keys: Sequence[str],
    x: Sequence[Column] | Column,
    y: Column,
    issues: Column | None = None,
    date: str = "datetime",
) -> DataFrame:
    """Packed upper triangle of Z'Z per key, with Z = (1, x, y), in column ``gram``.

    A short list ``x`` becomes one generated-code aggregate with a sum per product. An array column
    ``x``, of any length and not the same length for all keys, unfolds to one row per product.

    With ``issues`` (an array of dates) the key gains an ``issue`` column and each matrix covers the
    rows dated before it. These are running sums over months, looked up at each issue date, so the
    rows are not multiplied by the number of issue dates.
    """
    if not isinstance(x, Column) and len(x) > WIDE_LIMIT:
        x = F.array(*x)
    make = _tall_gram if isinstance(x, Column) else _wide_gram
    return make(df, list(keys), x, y.cast("double"), issues, date)


def _running(sums: DataFrame, keys, columns, issues, date) -> DataFrame:
    """Sums per month to sums of all months before each issue date."""
    w = Window.partitionBy(*keys).orderBy(date)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    state = sums.select(
        *keys, date, F.lead(date).over(w).alias("_next"), issues.alias("_issues"),
        *[F.sum(c).over(so_far).alias(c) for c in columns],
    )
    holds = F.filter("_issues", lambda i: (i > F.col(date)) & (F.col("_next").isNull() | (i <= F.col("_next"))))
    return state.select(*keys, *columns, F.explode(holds).alias("issue"))


def _wide_gram(df, keys, x, y, issues, date):
    names = ["_1", *[f"_x{i}" for i in range(len(x))], "_y"]
    rows = df.select(
        *keys, *([date] if issues is not None else []),
        F.lit(1.0).alias("_1"), *[c.cast("double").alias(n) for c, n in zip(x, names[1:])], y.alias("_y"),
    )
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    columns = [f"_s{i}" for i in range(len(pairs))]
    sums = [F.expr(f"sum({a} * {b}) AS {c}") for (a, b), c in zip(pairs, columns)]
    if issues is None:
        out = rows.groupBy(*keys).agg(*sums)
        return out.select(*keys, F.array(*columns).alias("gram"))
    out = _running(rows.groupBy(*keys, date).agg(*sums), keys, columns, issues, date)
    return out.select(*keys, "issue", F.array(*columns).alias("gram"))


def _tall_gram(df, keys, x, y, issues, date):
    dated = [date] if issues is not None else []
    rows = df.select(*keys, *dated, F.concat(F.array(F.lit(1.0)), x, F.array(y)).alias("_z"))
    products = F.flatten(
        F.transform("_z", lambda a, i: F.transform(F.slice("_z", i + 1, F.size("_z") - i), lambda b: a * b))
    )
    cells = rows.select(*keys, *dated, F.posexplode(products).alias("_pos", "_s"))
    sums = cells.groupBy(*keys, "_pos", *dated).agg(F.sum("_s").alias("_s"))
    if issues is not None:
        sums = _running(sums, [*keys, "_pos"], ["_s"], issues, date)
        keys = [*keys, "issue"]
    packed = F.sort_array(F.collect_list(F.struct("_pos", "_s")))
    return sums.groupBy(*keys).agg(F.transform(packed, lambda c: c["_s"]).alias("gram"))


def unpack(packed) -> np.ndarray:
    """Symmetric matrix from its packed upper triangle; a stack of matrices from a stack of triangles."""
    values = np.asarray(packed, dtype=float)
    k = int((np.sqrt(8 * values.shape[-1] + 1) - 1) / 2)
    full = np.zeros((*values.shape[:-1], k, k))
    row, column = np.triu_indices(k)
    full[..., row, column] = values
    full[..., column, row] = values
    return full


def ridge_solve(g: np.ndarray, ridge: float | np.ndarray = 0.0) -> np.ndarray:
    """Coefficients (intercept first) minimising squared error plus ``ridge`` times their squares, for a stack.

    The intercept is not penalised. Regressors are scaled for the solve only; directions without
    variation get the smallest coefficients.
    """
    a, b = g[..., :-1, :-1].copy(), g[..., :-1, -1]
    k = a.shape[-1]
    scale = np.sqrt(np.maximum(np.diagonal(a, axis1=-2, axis2=-1), 1e-300))
    a[..., range(1, k), range(1, k)] += np.asarray(ridge, float)[..., None]
    values, vectors = np.linalg.eigh(a / (scale[..., :, None] * scale[..., None, :]))
    known = np.abs(values) > 1e-12 * np.abs(values).max(axis=-1, keepdims=True)
    inverse = np.where(known, 1 / np.where(known, values, 1.0), 0.0)
    turned = np.einsum("...ji,...j->...i", vectors, b / scale)
    return np.einsum("...ij,...j->...i", vectors, inverse * turned) / scale


def fit_rows(g: np.ndarray, coef: np.ndarray, ridge: float | np.ndarray = 0.0) -> tuple:
    """Fit summaries of a stack, from the matrices alone: n, coef, rss, residual sd, normal-equation gap."""
    n = g[:, 0, 0]
    v = np.concatenate([coef, -np.ones((len(g), 1))], axis=1)
    moments = np.einsum("mij,mj->mi", g, v)
    rss = np.maximum(np.einsum("mi,mi->m", v, moments), 0.0)
    mean = moments[:, 0] / n
    sd = np.sqrt(np.maximum(rss - n * mean * mean, 0.0) / np.maximum(n - 1, 1))
    gaps = moments[:, :-1].copy()
    gaps[:, 1:] += np.asarray(ridge, float).reshape(-1, 1) * coef[:, 1:]
    size = np.sqrt(np.diagonal(g, axis1=1, axis2=2)[:, :-1] * g[:, -1, -1][:, None])
    gap = (np.abs(gaps) / np.maximum(size, 1e-300)).max(axis=1)
    return n, coef.tolist(), rss, [x if k > 1 else None for x, k in zip(sd.tolist(), n)], gap


def solve_rows(grams: DataFrame, keys: Sequence[str], solver: Callable, columns: str) -> DataFrame:
    """Apply ``solver`` to the matrices of an Arrow batch, all of one size at once.

    ``solver`` takes a stack (m, k, k) and returns one sequence of m values per column but the last, ``error``: the
    message of a fit that fails, which costs no other fit.
    """
    carried = list(keys)
    types = dict(grams.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in carried) + ", " + columns
    names = [c.split()[0] for c in columns.replace("array<double>", "a").split(", ")]

    def run(batches):
        for pdf in batches:
            for _, some in pdf.groupby(pdf["gram"].map(len), sort=False):
                packed = some["gram"].to_list()
                found, errors = isolated(lambda at: list(zip(*solver(unpack(np.stack([packed[i] for i in at]))))), len(packed))
                values = [(*(r if r is not None else [None] * (len(names) - 1)), e) for r, e in zip(found, errors)]
                result = pd.DataFrame(values, columns=names, dtype=object)
                yield pd.concat([some[carried].reset_index(drop=True), result], axis=1)

    return grams.select(*carried, "gram").mapInPandas(run, schema)


def ridge_rows(ridge: float) -> Callable:
    """Solver of a stack of matrices with one penalty."""
    return lambda g: fit_rows(g, ridge_solve(g, np.full(len(g), ridge)), ridge)


def fit_designs(designs: Sequence[np.ndarray], solver: Callable = ridge_rows(0.0)) -> dict[str, list]:
    """FIT_COLUMNS of fits on designs (1, x, y), one row per observation; designs of one width are solved at once."""
    out = {c.split()[0]: [None] * len(designs) for c in FIT_COLUMNS.replace("array<double>", "a").split(", ")}
    by_width: dict[int, list[int]] = {}
    for i, z in enumerate(designs):
        by_width.setdefault(z.shape[1], []).append(i)
    for at in by_width.values():
        found, errors = isolated(lambda some: list(zip(*solver(np.stack([designs[at[i]].T @ designs[at[i]] for i in some])))), len(at))
        for i, values, error in zip(at, found, errors):
            out["error"][i] = error
            for column, v in zip(out.values(), values or ()):
                column[i] = v
    return out


def gram_fit(
    df: DataFrame,
    keys: Sequence[str],
    x: Sequence[Column] | Column,
    y: Column,
    ridge: float = 0.0,
    issues: Column | None = None,
    date: str = "datetime",
) -> DataFrame:
    """Keyed ridge regression of ``y`` on ``x`` and an intercept; ``x`` as in ``gram``."""
    grams = gram(df, keys, x, y, issues, date)
    out_keys = [c for c in grams.columns if c != "gram"]
    return solve_rows(grams, out_keys, ridge_rows(ridge), FIT_COLUMNS)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def with_intercept(x: Column) -> Column:
    return F.concat(F.array(F.lit(1.0)), x)


def elastic_net_path(
    g: np.ndarray, lambdas: np.ndarray, alphas: np.ndarray, tolerance: float = 1e-9, sweeps: int = 10_000
) -> np.ndarray:
    """Coordinate descent for a stack of matrices and their penalties, all at once, until nothing moves.

    ``g`` has shape (m, k, k); penalties are one list for all, or (m, penalties). The result (m, penalties, k - 1)
    holds raw coefficients, intercept first. Problems that no longer move leave the stack, and of the others only
    coordinates that are not at rest at zero are visited between full sweeps. ``elastic_net_gap`` tells how far a
    result is from the optimum.
    """
    mean, sd, rxx, rxy = _standardized(g)
    m, p = rxy.shape
    soft, hard = (np.broadcast_to(v, (m, np.shape(v)[-1])).ravel() for v in (lambdas * alphas, 1 + lambdas * (1 - alphas)))
    each = len(soft) // m if m else 0
    b, own = np.zeros((len(soft), p)), np.repeat(np.arange(m), each)
    moving = np.arange(len(soft))
    for sweep in range(sweeps):
        if not len(moving):
            break
        now, r, target, s, h = b[moving], rxx[own[moving]], rxy[own[moving]], soft[moving], hard[moving]
        full = sweep % 8 == 0
        moved = np.zeros(len(moving))
        for j in range(p):
            at = slice(None) if full else np.flatnonzero(now[:, j])
            partial = target[at, j] - np.einsum("mk,mk->m", r[at, j], now[at]) + now[at, j]
            new = np.sign(partial) * np.maximum(np.abs(partial) - s[at], 0) / h[at]
            moved[at] = np.maximum(moved[at], np.abs(new - now[at, j]))
            now[at, j] = new
        b[moving] = now
        # Only a full sweep tells that coordinates at zero stay there.
        if full:
            moving = moving[moved > tolerance]
    b = b.reshape(m, each, p)
    raw = b * (sd[:, None, -1:] / sd[:, None, :-1])
    intercept = mean[:, None, -1] - np.einsum("mlk,mk->ml", raw, mean[:, :-1])
    return np.concatenate([intercept[:, :, None], raw], axis=2)


def largest_penalty(g: np.ndarray) -> np.ndarray:
    """Per matrix the penalty from which on the lasso has no coefficients, on the scale of correlations."""
    return np.abs(_standardized(g)[3]).max(axis=1)


def _standardized(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Means and spreads, correlations among regressors and with the target."""
    n = g[:, 0, 0][:, None]
    mean = g[:, 0, 1:] / n
    cov = g[:, 1:, 1:] / n[:, :, None] - mean[:, :, None] * mean[:, None, :]
    sd = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 1e-300))
    r = cov / (sd[:, :, None] * sd[:, None, :])
    return mean, sd, r[:, :-1, :-1], r[:, :-1, -1]


def elastic_net_gap(g: np.ndarray, coef: np.ndarray, lambdas: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Largest violation of the optimality conditions, on the scale of correlations; one penalty per matrix."""
    _, sd, rxx, rxy = _standardized(g)
    b = coef[:, 1:] * sd[:, :-1] / sd[:, -1:]
    slope = rxy - np.einsum("mij,mj->mi", rxx, b) - (lambdas * (1 - alphas))[:, None] * b
    bound = (lambdas * alphas)[:, None]
    active = np.abs(slope - bound * np.sign(b))
    return np.where(b != 0, active, np.maximum(np.abs(slope) - bound, 0)).max(axis=1)
