"""Tree models: a random forest and boosted trees per series and issue date, driver importance, a pooled fit.

A series is bounded by the calendar, so each fit's rows travel packed in one row of an Arrow batch, dealt over
the cluster by series; all trees of a batch grow together (``operators.treegrow``). Nothing loops over series or
issue dates on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.labels import DRIVER_LABELS, VEGETATION_LABELS, recode, temperature_label
from fluxloom.functions.values import fold_transect
from fluxloom.operators import linalg, treegrow
from fluxloom.operators.aggregates import PREDICTORS
from fluxloom.operators.isolate import isolated
from fluxloom.operators.joins import join_treatments
from fluxloom.plans.common import FITS, SERIES, finish_forecast, issue_lookup, placed, register_model
from fluxloom.plans.driver_models import (
    SEED, by_month, complete_rows, driver_training, ensemble_to_normal, flat_members, predictors,
)

#: Trees, predictors tried per cut, and rows that a node needs more of to be cut.
TREES, TRIED, LEAST = 500, max(1, len(PREDICTORS) // 3), 5
#: Boosting rounds at most, folds, rounds without a better one, learning rate, depth, ridge on leaves.
ROUNDS, FOLDS, PATIENCE, RATE, BOOST_DEPTH, RIDGE = 100, 10, 2, 0.3, 6, 1.0
#: A forest's trees grow until nodes are small; this only bounds odd cases.
FULL_DEPTH = 60
SITE_COLUMNS = ("site_mean", "site_sd")

Solver = Callable[[list, list, list, list], list[treegrow.Fitted]]


def packed_fits(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per fit: dates, observations and predictors (row by row) in date order, and a seed of the key."""
    row = F.struct("datetime", "observation", predictors().alias("x"))
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return packed.select(
        *keys,
        F.col("rows.datetime").alias("at"),
        F.col("rows.observation").alias("y"),
        F.flatten(F.col("rows.x")).alias("x"),
        F.xxhash64(*[F.col(k).cast("string") for k in keys], F.lit(SEED)).alias("seed"),
    )


def _doubles(column: pa.Array) -> list[np.ndarray]:
    """Rows of a list column as arrays."""
    column = pa.concat_arrays([column]) if not isinstance(column, pa.ChunkedArray) else column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)))
    return np.split(flat, ends[:-1])


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0), pa.float64()))


RESULTS = "fitted array<double>, members array<double>, residual_sd double, rounds int, base double, rise array<double>, spread array<double>, error string"


def solved(packed: DataFrame, keys: Sequence[str], solver: Solver) -> DataFrame:
    """``packed`` with each fit's results: its rows predicted, its members (column ``future``) predicted, spread; a
    fit that fails has the message in ``error`` and no numbers."""
    types = dict(packed.dtypes)
    kept = [*keys, "at", "y"]
    schema = ", ".join(f"`{k}` {types[k]}" for k in kept) + ", " + RESULTS
    width = len(PREDICTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
            targets = _doubles(column("y"))
            designs, new = ([x.reshape(-1, width) for x in _doubles(column(c))] for c in ("x", "future"))
            seeds = column("seed").to_pylist()
            take = lambda values, at: [values[i] for i in at]
            found, errors = isolated(lambda at: solver(*(take(v, at) for v in (designs, targets, new, seeds))), len(targets))
            found = [f or treegrow.Fitted(np.full(len(y), np.nan), np.full(len(m), np.nan)) for f, y, m in zip(found, targets, new, strict=True)]
            gaps = [f.rows - y for f, y in zip(found, targets, strict=True)]
            gaps = [g[~np.isnan(g)] for g in gaps]
            none = np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [
                    *[column(k) for k in kept],
                    _lists([f.rows for f in found]),
                    _lists([f.new for f in found]),
                    pa.array([float(g.std(ddof=1)) if len(g) > 1 else None for g in gaps], pa.float64()),
                    pa.array([f.rounds for f in found], pa.int32()),
                    pa.array([f.base for f in found], pa.float64()),
                    _lists([f.rise if f.rise is not None else none for f in found]),
                    _lists([f.spread if f.spread is not None else none for f in found]),
                    pa.array(errors, pa.string()),
                ],
                names=[*kept, *[c.split()[0] for c in RESULTS.split(", ")]],
            )

    needed = packed if "future" in packed.columns else packed.withColumn("future", F.array().cast("array<double>"))
    return needed.select(*kept, "x", "seed", "future").mapInArrow(run, schema)


def forest_solver(trees: int = TREES, tried: int = TRIED, least: int = LEAST, importance: bool = False) -> Solver:
    return lambda x, y, new, seeds: treegrow.forests(x, y, new, seeds, trees, tried, least, FULL_DEPTH, importance)


def boosting_solver(rounds: int = ROUNDS, folds: int = FOLDS, patience: int = PATIENCE) -> Solver:
    return lambda x, y, new, seeds: treegrow.boosted(x, y, new, seeds, rounds, folds, patience, RATE, BOOST_DEPTH, RIDGE)


def fitted_rows(monthly, drivers, issues, solver: Solver | None = None) -> DataFrame:
    """Training rows of every fit with its prediction: out of bag for a forest (null where no tree left the row
    out), in sample for boosting."""
    fits = solved(packed_fits(driver_training(monthly, drivers, issues), FITS), FITS, solver or forest_solver())
    rows = fits.select(*FITS, "rounds", F.explode(F.arrays_zip("at", "y", "fitted")).alias("r"))
    return rows.select(
        *FITS, "rounds", F.col("r.at").alias("datetime"), F.col("r.y").alias("observation"), F.nanvl("r.fitted", F.lit(None)).alias("prediction")
    )


def _forecast(monthly, drivers, issues, solver: Solver, model_id: str) -> DataFrame:
    """Every member of the latest ensemble predicted by each fit; spread adds members and residuals."""
    flat = flat_members(drivers, issues)
    packed = packed_fits(driver_training(monthly, drivers, issues), FITS)
    fits = solved(packed.withColumn("future", issue_lookup(flat, "ahead").x), FITS, solver)
    return finish_forecast(ensemble_to_normal(by_month(fits, flat)), model_id)


@register_model("randomForest")
def fc_random_forest(monthly, drivers, issues, trees: int = TREES) -> DataFrame:
    """A forest per series and issue date; residual spread from out-of-bag predictions."""
    return _forecast(monthly, drivers, issues, forest_solver(trees), "randomForest")


@register_model("XGBoost")
def fc_gbt(monthly, drivers, issues, rounds: int = ROUNDS, folds: int = FOLDS, patience: int = PATIENCE) -> DataFrame:
    """Boosted trees per series and issue date; rounds by cross-validation with early stopping, in-sample residuals."""
    return _forecast(monthly, drivers, issues, boosting_solver(rounds, folds, patience), "XGBoost")


def driver_importance(monthly, drivers, treatments, trees: int = TREES) -> DataFrame:
    """Per site and driver the percent rise of out-of-bag squared error when the driver is shuffled (``IncMSE``), and
    the rise over its standard error between trees (``scaled``).

    One forest per site on all its complete rows; the shuffle is inside each tree's out-of-bag rows.
    """
    rows = placed(complete_rows(monthly, drivers))
    fits = solved(packed_fits(rows, SERIES), SERIES, forest_solver(trees, importance=True))
    names = F.array(*[F.lit(p) for p in PREDICTORS])
    each = fits.select(*SERIES, "base", F.explode(F.arrays_zip(names.alias("name"), "rise", "spread")).alias("r")).select(
        *SERIES, "base", F.col("r.name").alias("driver"), "r.rise", "r.spread"
    )
    labelled = join_treatments(each, treatments).where(F.col("CO2Treat") == "Amb")
    return labelled.select(
        "site_id",
        recode(F.col("Veg"), VEGETATION_LABELS).alias("Veg"),
        temperature_label(F.col("Temp")).alias("Temp"),
        fold_transect(F.col("Transect")).alias("Transect"),
        recode(F.col("driver"), DRIVER_LABELS).alias("name"),
        (F.try_divide("rise", "base") * 100).alias("IncMSE"),
        F.try_divide("rise", "spread").alias("scaled"),
    )


# ---- one fit for all sites ----------------------------------------------------------------------


def site_profile(train: DataFrame) -> DataFrame:
    """Level and spread of each series within its training window: what a pooled fit knows of a site."""
    return train.groupBy(*FITS).agg(
        F.avg("observation").alias("site_mean"), F.coalesce(F.stddev_samp("observation"), F.lit(0.0)).alias("site_sd")
    )


def pooled_fit(monthly, drivers, issues) -> DataFrame:
    """One linear fit across all sites per issue date: every training row with its prediction and the coefficients.

    Sums of products per issue date combine on the map side, so all dates are one job.
    """
    rows = driver_training(monthly, drivers, issues)
    rows = rows.join(site_profile(rows), list(FITS)).withColumn("x", F.array(*PREDICTORS, *SITE_COLUMNS))
    inputs = [F.get("x", F.lit(i)) for i in range(len(PREDICTORS) + len(SITE_COLUMNS))]
    coefficients = linalg.gram_fit(rows, ["issue"], inputs, F.col("observation")).select("issue", "coef")
    fitted = rows.withColumn("coef", issue_lookup(coefficients, "coef"))
    return fitted.select(
        *FITS, "datetime", "observation", "x", "coef", linalg.dot(F.col("coef"), linalg.with_intercept(F.col("x"))).alias("prediction")
    )
