"""Models on weather drivers: elastic net, kernel ridge on fixed features, Bayesian net.

Each fits on lead-1 ensemble means and predicts every member of the latest ensemble. Fits need one
matrix per series and issue date; the members of an issue date travel as one nested array, so
prediction adds no shuffle: member mean and spread are taken inside the row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.functions.values import constant
from fluxloom.operators.aggregates import PREDICTORS, future_drivers, past_driver_mean
from fluxloom.operators.cleaning import drop_incomplete, min_rows_per_key
from fluxloom.operators.isolate import isolated
from fluxloom.operators.joins import join_drivers
from fluxloom.operators.linalg import (
    FIT_COLUMNS, dot, elastic_net_gap, elastic_net_path, fit_designs, fit_rows, largest_penalty, ridge_rows, unpack,
    with_intercept,
)
from fluxloom.operators.smallnets import chosen_nets, outputs
from fluxloom.plans.common import (
    FITS, SERIES, carried, finish_forecast, issue_array, issue_lookup, placed, register_model, training_window,
)

LEAST_ROWS = 10
SEED = 7


def complete_rows(monthly: DataFrame, drivers: DataFrame) -> DataFrame:
    """Months with an observation and every driver, the unused one included."""
    return drop_incomplete(join_drivers(monthly, past_driver_mean(drivers)))


def driver_training(monthly: DataFrame, drivers: DataFrame, issues: DataFrame) -> DataFrame:
    """Training rows per series and issue date, series below ten rows skipped."""
    rows = training_window(complete_rows(monthly, drivers), issues)
    return min_rows_per_key(rows, FITS, "observation", LEAST_ROWS)


def predictors() -> Column:
    return F.array(*PREDICTORS)


def member_arrays(drivers: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per issue date: its months, each with the predictor vectors of all members.

    Bounded by ensemble size times lead months.
    """
    members = future_drivers(drivers, issues).dropna(subset=list(PREDICTORS))
    months = members.groupBy("issue", "datetime").agg(
        F.sort_array(F.collect_list(F.struct("parameter", predictors().alias("x")))).alias("members")
    )
    return months.groupBy("issue").agg(F.collect_list(F.struct("datetime", "members")).alias("future"))


def flat_members(drivers: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per issue date: ``ahead`` with all members' predictors end to end (x) and each month's number of members (months)."""
    future = member_arrays(drivers, issues)
    sizes = F.transform("future", lambda m: F.size(m.members))
    return future.select(
        "issue",
        F.struct(
            F.flatten(F.flatten(F.transform("future", lambda m: F.transform(m.members, lambda q: q.x)))).alias("x"),
            F.zip_with("future", sizes, lambda m, n: F.struct(m.datetime.alias("datetime"), n.alias("n"))).alias("months"),
        ).alias("ahead"),
    )


def by_month(fits: DataFrame, flat: DataFrame) -> DataFrame:
    """Predictions of all members end to end (``members``) as one row per month."""
    months = fits.select(*FITS, "members", "residual_sd", "error", issue_lookup(flat, "ahead").months.alias("months"))
    each = months.select(*FITS, "members", "residual_sd", "error", "months", F.posexplode("months").alias("k", "m"))
    before = F.aggregate(F.slice("months", F.lit(1), F.col("k")), F.lit(0), lambda s, m: s + m.n)
    return each.select(
        *FITS, "residual_sd", "error", F.col("m.datetime").alias("datetime"), F.slice("members", before + 1, F.col("m.n")).alias("members")
    )


def apply_to_members(fits: DataFrame, future: DataFrame, predict: Callable[[Column], Column]) -> DataFrame:
    """The same fit over every member and lead month: FITS, datetime, ``members`` (predictions)."""
    rows = fits.withColumn("_f", F.explode(issue_lookup(future, "future")))
    return rows.select(
        *FITS, "residual_sd", *carried(fits, "error"), F.col("_f.datetime").alias("datetime"),
        F.transform("_f.members", lambda m: predict(m.x)).alias("members"),
    )


def ensemble_to_normal(predictions: DataFrame) -> DataFrame:
    """Member mean; spread adds member and residual variance. Null spread for a single member."""
    size = F.size("members")
    mean = F.aggregate("members", F.lit(0.0), lambda s, v: s + v) / size
    rows = predictions.withColumn("mu", mean)
    squares = F.aggregate("members", F.lit(0.0), lambda s, v: s + (v - F.col("mu")) * (v - F.col("mu")))
    variance = F.try_divide(squares, F.when(size > 1, size - 1))
    return rows.withColumn("sigma", F.sqrt(variance + F.col("residual_sd") * F.col("residual_sd")))


def fit_residual_sd(predictions: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Spread of prediction less observation per key."""
    return predictions.groupBy(*keys).agg(
        F.stddev_samp(F.col("prediction") - F.col("observation")).alias("residual_sd")
    )


def cv_folds(df: DataFrame, key: Sequence[str], k: int, repeats: int = 1, seed: int = SEED) -> DataFrame:
    """Repeated fold numbers from a hash of the row key: the same however the data is partitioned."""
    tagged = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return tagged.withColumn("fold", F.pmod(F.xxhash64(*key, "repeat", F.lit(seed)), F.lit(k)).cast("int"))


def standardize(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Centre and scale per key; a constant column becomes zero. Keys are bounded training series."""
    w = Window.partitionBy(*keys)
    scaled = lambda c: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w)), F.lit(0.0))
    return df.withColumns({c: scaled(c) for c in columns})


def _scales(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*FITS).agg(
        F.array(*[F.avg(c) for c in PREDICTORS]).alias("centre"),
        F.array(*[F.stddev_samp(c) for c in PREDICTORS]).alias("scale"),
    )


def _scaled(x: Column) -> Column:
    gap = F.zip_with(x, F.col("centre"), lambda a, b: a - b)
    return F.zip_with(gap, F.col("scale"), lambda a, s: F.coalesce(F.try_divide(a, s), F.lit(0.0)))


# ---- elastic net ------------------------------------------------------------------------------

#: Pairs of mixing and penalty that a fit's random search draws, and how far below the largest penalty, in powers of two.
CANDIDATES, OCTAVES = 25, 10.0
#: Fits solved at once.
STEP = 200


def drawn_penalties(seeds: Sequence[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixing and share of the largest penalty of each candidate, by the fit's own seed."""
    draws = np.stack([np.random.default_rng(s & (2**63 - 1)).uniform(size=(2, n)) for s in seeds])
    return draws[:, 0], 2.0 ** (-OCTAVES * draws[:, 1])


def choose_elastic_nets(fits: Sequence, seeds: Sequence[int], candidates: int = CANDIDATES) -> list[tuple]:
    """Mixing and penalty of each fit by random search under repeated cross-validation, then the fit on all its rows.

    A fit is a list of (repeat, fold, packed matrix); the matrices of a repeat sum to the whole. All fits, folds
    and candidates are one stack.
    """
    g = [unpack(np.stack([p[2] for p in parts])) for parts in fits]
    repeats = [np.array([p[0] for p in parts]) for parts in fits]
    whole = np.stack([m[r == r.min()].sum(axis=0) for m, r in zip(g, repeats)])
    alphas, shares = drawn_penalties(seeds, candidates)
    lambdas = shares * largest_penalty(whole)[:, None]
    own = np.repeat(np.arange(len(fits)), [len(m) for m in g])
    held_out = np.concatenate(g)
    held_in = whole[own] - held_out
    usable = held_in[:, 0, 0] >= 3
    own, held_in, held_out = own[usable], held_in[usable], held_out[usable]
    b = elastic_net_path(held_in, lambdas[own], alphas[own])
    v = np.concatenate([b, -np.ones((*b.shape[:2], 1))], axis=2)
    error = np.zeros((len(fits), candidates))
    np.add.at(error, own, np.einsum("mlj,mjk,mlk->ml", v, held_out, v))
    best = error.argmin(axis=1)[:, None]
    chosen_a, chosen_l = np.take_along_axis(alphas, best, axis=1), np.take_along_axis(lambdas, best, axis=1)
    coef = elastic_net_path(whole, chosen_l, chosen_a)[:, 0]
    gap = elastic_net_gap(whole, coef, chosen_l[:, 0], chosen_a[:, 0])
    n, coef, rss, sd, _ = fit_rows(whole, coef)
    return list(zip(n, coef, rss, sd, chosen_a[:, 0].tolist(), chosen_l[:, 0].tolist(), gap.tolist()))


def fold_grams(z: np.ndarray, folds: np.ndarray, k: int) -> list[tuple]:
    """(repeat, fold, packed matrix) of every fold that holds rows; ``z`` are rows (1, x, y), ``folds`` one column per repeat."""
    i, j = np.triu_indices(z.shape[1])
    products = z[:, i] * z[:, j]
    out = []
    for repeat in range(folds.shape[1]):
        inside = folds[:, repeat] == np.arange(k)[:, None]
        sums = inside.astype(float) @ products
        out += [(repeat + 1, fold, sums[fold]) for fold in np.flatnonzero(inside.any(axis=1)).tolist()]
    return out


def elastic_net_fit(monthly, drivers, issues, folds: int = 5, repeats: int = 5) -> DataFrame:
    """A series is bounded, so its rows travel packed, once for all issue dates; the matrices of folds are summed beside the solve."""
    rows = placed(complete_rows(monthly, drivers))
    number = lambda r: F.pmod(F.xxhash64("site_id", "variable", "datetime", r, F.lit(SEED)), F.lit(folds)).cast("int")
    row = F.struct(
        "datetime", F.concat(F.array(F.lit(1.0)), predictors(), F.array("observation")).alias("z"),
        F.transform(F.sequence(F.lit(1), F.lit(repeats)), number).alias("folds"),
    )
    packed = rows.groupBy(*SERIES).agg(F.sort_array(F.collect_list(row)).alias("rows")).withColumn("issues", issue_array(issues))
    named = lambda i: F.xxhash64(*[F.col(k).cast("string") for k in SERIES], i.cast("string"), F.lit(SEED))
    # Rows are in order of dates: those before an issue date are the first so many.
    before = lambda i: F.size(F.filter("rows", lambda r: r.datetime < i))
    packed = packed.select(
        *SERIES, F.flatten("rows.z").alias("z"), F.flatten("rows.folds").alias("folds"),
        F.filter(F.transform("issues", lambda i: F.struct(i.alias("issue"), before(i).alias("n"), named(i).alias("seed"))), lambda d: d.n >= LEAST_ROWS).alias("dates"),
    )
    types = dict(monthly.dtypes) | dict(issues.dtypes)
    names = ["n", "coef", "rss", "residual_sd", "alpha", "lambda", "gap", "error"]
    schema = ", ".join(f"`{k}` {types[k]}" for k in FITS) + (
        ", n double, coef array<double>, rss double, residual_sd double, alpha double, lambda double, gap double, error string"
    )

    def solved(held):
        keys, parts, seeds = zip(*held)
        found, errors = isolated(lambda at: choose_elastic_nets([parts[i] for i in at], [seeds[i] for i in at]), len(parts))
        fitted = [(*k, *(r or [None] * 7), e) for k, r, e in zip(keys, found, errors)]
        return pd.DataFrame(fitted, columns=[*FITS, *names], dtype=object)

    def run(batches):
        held = []
        for pdf in batches:
            for *series, z, numbers, dates in pdf[[*SERIES, "z", "folds", "dates"]].itertuples(index=False, name=None):
                z = np.asarray(z, float).reshape(-1, len(PREDICTORS) + 2)
                numbers = np.asarray(numbers).reshape(-1, repeats)
                for d in dates:
                    held.append(((*series, d["issue"]), fold_grams(z[: d["n"]], numbers[: d["n"]], folds), d["seed"]))
                    if len(held) == STEP:
                        yield solved(held)
                        held = []
        if held:
            yield solved(held)

    return packed.mapInPandas(run, schema)


@register_model("elasticNet")
def fc_elastic_net(monthly, drivers, issues) -> DataFrame:
    """Elastic net on five drivers; penalty and mixing by random search under repeated cross-validation."""
    predict = lambda x: dot(F.col("coef"), with_intercept(x))
    fits = elastic_net_fit(monthly, drivers, issues)
    out = ensemble_to_normal(apply_to_members(fits, member_arrays(drivers, issues), predict))
    return finish_forecast(out, "elasticNet")


# ---- models on fixed random features ----------------------------------------------------------


#: Default number of random features of the kernel; a parameter of the fits.
KERNEL_FEATURES = 64


def interactions(x: Column) -> Column:
    """All products of one to five drivers: 31 columns."""
    return F.array(*[prod((F.get(x, F.lit(i)) for i in s), start=F.lit(1.0)) for s in driver_sets()])


def driver_sets() -> list[tuple[int, ...]]:
    """Places of the drivers in each product of one to five of them."""
    n = len(PREDICTORS)
    return [s for r in range(1, n + 1) for s in combinations(range(n), r)]


def _weights(rows: int, columns: int, spread: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeded normal weights with a uniform phase."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, spread, (rows, columns)), rng.uniform(0, 2 * np.pi, rows)


def fourier_features(x: Column, size: int = KERNEL_FEATURES, seed: int = SEED) -> Column:
    """Random Fourier features of a radial kernel of width one over the columns (Rahimi and Recht 2007)."""
    columns = 2 ** len(PREDICTORS) - 1
    w, phase = _weights(size, columns, float(np.sqrt(2 / columns)), seed)
    weights = constant([{"w": [float(v) for v in w[i]], "b": float(phase[i])} for i in range(size)])
    return F.transform(weights, lambda r: F.cos(dot(r.w, x) + r.b) * float(np.sqrt(2 / size)))


def kernel_stages(features: int = KERNEL_FEATURES) -> tuple[Callable, ...]:
    return interactions, lambda x: fourier_features(x, features)


def kernel_rows(features: int = KERNEL_FEATURES, seed: int = SEED) -> Callable[[np.ndarray], np.ndarray]:
    """``kernel_stages`` on rows of standardised drivers: one matrix product for all rows."""
    columns = 2 ** len(PREDICTORS) - 1
    w, phase = _weights(features, columns, float(np.sqrt(2 / columns)), seed)
    sets = driver_sets()

    def run(x: np.ndarray) -> np.ndarray:
        products = np.stack([x[:, s].prod(axis=1) for s in sets], axis=1)
        return np.cos(products @ w.T + phase) * np.sqrt(2 / features)

    return run


def scaled_rows(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Rows less their centre, by scale; a constant column becomes zero."""
    return np.where(scale > 0, (x - centre) / np.where(scale > 0, scale, 1.0), 0.0)


def kernel_ridge_fit(monthly, drivers, issues, ridge: float = 1.0, features: int = KERNEL_FEATURES) -> DataFrame:
    """Fits on features of the standardised drivers. A series is bounded, so its rows travel packed to one solve; scales
    and features are taken there, as Spark's functions on arrays go element by element."""
    row = F.struct("datetime", "observation", predictors().alias("x"))
    packed = driver_training(monthly, drivers, issues).groupBy(*FITS).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    packed = packed.select(*FITS, F.flatten("rows.x").alias("x"), F.col("rows.observation").alias("y"))
    types, width = dict(packed.dtypes), len(PREDICTORS)
    expand, solver = kernel_rows(features), ridge_rows(ridge)

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), STEP):
                pdf = batch.iloc[start : start + STEP]
                designs, centres, scales = [], [], []
                for x, y in zip(pdf["x"], pdf["y"]):
                    x = np.asarray(x, float).reshape(-1, width)
                    centre, scale = x.mean(axis=0), np.where(x.max(axis=0) > x.min(axis=0), x.std(axis=0, ddof=1), 0.0)
                    designs.append(np.column_stack([np.ones(len(y)), expand(scaled_rows(x, centre, scale)), y]))
                    centres.append(centre.tolist())
                    scales.append(scale.tolist())
                fits = pd.DataFrame({**fit_designs(designs, solver), "centre": centres, "scale": scales}, dtype=object)
                yield pd.concat([pdf[list(FITS)].reset_index(drop=True), fits], axis=1)

    schema = ", ".join(f"`{k}` {types[k]}" for k in FITS) + ", " + FIT_COLUMNS + ", centre array<double>, scale array<double>"
    return packed.mapInPandas(run, schema)


@register_model("svm")
def fc_kernel_ridge(monthly, drivers, issues, ridge: float = 1.0, features: int = KERNEL_FEATURES) -> DataFrame:
    """Kernel ridge on the full interaction design: squared loss, approximate radial kernel."""
    flat = flat_members(drivers, issues)
    fits = kernel_ridge_fit(monthly, drivers, issues, ridge, features).withColumn("future", issue_lookup(flat, "ahead").x)
    types, width, expand = dict(fits.dtypes), len(PREDICTORS), kernel_rows(features)

    def run(batches):
        for pdf in batches:
            out = []
            for future, coef, centre, scale in zip(pdf["future"], pdf["coef"], pdf["centre"], pdf["scale"]):
                x = np.zeros((0, width)) if future is None else np.asarray(future, float).reshape(-1, width)
                if coef is None:
                    out.append([None] * len(x))
                else:
                    out.append((coef[0] + expand(scaled_rows(x, centre, scale)) @ coef[1:]).tolist())
            yield pdf[[*FITS, "residual_sd", "error"]].assign(members=out)

    schema = ", ".join(f"`{k}` {types[k]}" for k in (*FITS, "residual_sd", "error")) + ", members array<double>"
    rows = by_month(fits.select(*FITS, "residual_sd", "error", "future", "coef", "centre", "scale").mapInPandas(run, schema), flat)
    return finish_forecast(ensemble_to_normal(rows), "svm")


# ---- Bayesian net -----------------------------------------------------------------------------

#: Numbers of units compared, folds and repeats of the comparison.
UNITS, NET_FOLDS, NET_REPEATS = (1, 2, 3), 5, 5


def bayes_net_fit(monthly, drivers, issues, units: Sequence[int] = UNITS, folds: int = NET_FOLDS, repeats: int = NET_REPEATS) -> DataFrame:
    """Nets on the standardised drivers: FITS, n, units, net (w, b and v of each unit in turn), middle, half, residual_sd.

    A prediction is middle + half times the sum over units of w tanh(b + v.x). A series is bounded, so its rows
    travel packed; all nets of an Arrow batch are fitted together.
    """
    rows = driver_training(monthly, drivers, issues)
    samples = standardize(rows, FITS, PREDICTORS).select(*FITS, F.struct("datetime", "observation", predictors().alias("x")).alias("row"))
    packed = samples.groupBy(*FITS).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    packed = packed.select(
        *FITS, F.col("rows.x").alias("x"), F.col("rows.observation").alias("y"),
        F.xxhash64(*[F.col(k).cast("string") for k in FITS], F.lit(SEED)).alias("seed"),
    )
    types = dict(packed.dtypes)
    names = ["n", "units", "net", "middle", "half", "residual_sd", "error"]
    schema = ", ".join(f"`{k}` {types[k]}" for k in FITS) + ", n double, units int, net array<double>, middle double, half double, residual_sd double, error string"

    def run(batches):
        for pdf in batches:
            xs, ys = [np.stack(list(x)) for x in pdf["x"]], [np.asarray(y, float) for y in pdf["y"]]
            seeds = pdf["seed"].tolist()
            take = lambda values, at: [values[i] for i in at]
            found, errors = isolated(lambda at: chosen_nets(take(xs, at), take(ys, at), take(seeds, at), units, folds, repeats), len(ys))
            out = []
            for net, error, x, y in zip(found, errors, xs, ys):
                if net is None:
                    out.append((float(len(y)), None, None, None, None, None, error))
                    continue
                count, theta, middle, half = net
                gaps = middle + half * outputs(theta[None], x[None], count)[0][0] - y
                out.append((float(len(y)), count, theta.tolist(), middle, half, float(gaps.std(ddof=1)), None))
            yield pd.concat([pdf[list(FITS)].reset_index(drop=True), pd.DataFrame(out, columns=names, dtype=object)], axis=1)

    fits = packed.mapInPandas(run, schema)
    return fits.join(_scales(rows), list(FITS))


def net_output(x: Column) -> Column:
    """Prediction of a row's net (columns units, net, middle, half) at standardised drivers."""
    width = len(PREDICTORS) + 2
    unit = lambda k: F.get("net", k * width) * F.tanh(
        F.get("net", k * width + 1) + dot(F.slice("net", k * width + 3, F.lit(len(PREDICTORS))), x)
    )
    total = F.aggregate(F.sequence(F.lit(0), F.coalesce("units", F.lit(1)) - 1), F.lit(0.0), lambda s, k: s + unit(k))
    return F.col("middle") + F.col("half") * total


@register_model("brnn")
def fc_bayes_net(monthly, drivers, issues) -> DataFrame:
    """Two-layer net under Bayesian regularisation, both layers fitted; number of units by repeated cross-validation."""
    fits = bayes_net_fit(monthly, drivers, issues)
    return finish_forecast(ensemble_to_normal(apply_to_members(fits, member_arrays(drivers, issues), lambda x: net_output(_scaled(x)))), "brnn")
