"""Issuing forecasts, backfilling missing issue dates, replicate-group runs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.operators.aggregates import monthly_targets, rep_mean_targets
from fluxloom.operators.calendar import issue_calendar
from fluxloom.operators.isolate import isolated
from fluxloom.operators.joins import missing_issues
from fluxloom.plans.library import MODELS
from fluxloom.session import staged
from fluxloom.sources.tables import CATALOG_KEYS, CATALOG_SCHEMA, forecast_catalog, write_forecast

SEPARATE, REPLICATES = "separate", "comb_reps"


def replicate_mode(monthly: DataFrame) -> DataFrame:
    """The same run on replicate-group series."""
    return rep_mean_targets(monthly)


def issue_dates(spark: SparkSession, dates: Sequence[dt.date]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in dates])).alias("issue"))


def select_sites(monthly: DataFrame, sites: Sequence[str] | None) -> DataFrame:
    """All sites by default."""
    return monthly if sites is None else monthly.where(F.col("site_id").isin(*sites))


def variant_series(daily: DataFrame, variant: str) -> DataFrame:
    monthly = monthly_targets(daily)
    return replicate_mode(monthly) if variant == REPLICATES else monthly


def _tagged(model: str, monthly, drivers, issues, variant: str) -> DataFrame:
    """A model's forecast under its registered name."""
    forecast = MODELS[model](monthly, drivers, issues)
    return forecast.withColumns({"model_id": F.lit(model), "variant": F.lit(variant)})


def issue_forecast(
    model: str,
    daily: DataFrame,
    drivers: DataFrame | None,
    issues: DataFrame,
    variant: str = SEPARATE,
    sites: Sequence[str] | None = None,
) -> DataFrame:
    """Forecasts of one model at all given issue dates as one lazy plan, tagged with the variant.

    Fits that fail give no rows; ``backfill`` reports them.
    """
    monthly = select_sites(variant_series(daily, variant), sites)
    return _sound(_tagged(model, monthly, drivers, issues, variant))


def _sound(forecast: DataFrame) -> DataFrame:
    return forecast.where("error is null").drop("error") if "error" in forecast.columns else forecast


def required_issues(spark, model: str, variant: str, start: dt.date, end: dt.date) -> DataFrame:
    dates = issue_calendar(spark, start, end).withColumnRenamed("issue", "reference_datetime")
    return dates.withColumns({"model_id": F.lit(model), "variant": F.lit(variant)}).select(*CATALOG_KEYS)


def stored_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue of the store, empty before its first write."""
    try:
        return forecast_catalog(spark, path)
    except AnalysisException as error:
        # Only a store that is not there yet is empty; anything else must not lead to forecasting all again.
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CATALOG_SCHEMA)


def backfill(
    spark: SparkSession,
    model: str,
    daily: DataFrame,
    drivers: DataFrame | None,
    path: str,
    start: dt.date,
    end: dt.date,
    cutoff: dt.datetime | None = None,
    variant: str = SEPARATE,
) -> DataFrame:
    """Forecast and store every issue date that is missing or older than ``cutoff``.

    All dates run as one plan. A fit that fails inside its model costs itself: its message travels beside the
    forecasts. Should the plan itself fail, the dates are halved until those at fault stand alone, so the others
    run some few times at most. Returns one row per failed fit or date (issue, site_id, variable, message);
    series are null where a whole date failed. A date counts as stored once any of its series is; to run its
    failed series again, give a ``cutoff``.
    """
    cut = F.lit(cutoff if cutoff is not None else dt.datetime(1970, 1, 1)).cast("timestamp")
    todo = missing_issues(required_issues(spark, model, variant, start, end), stored_catalog(spark, path), cut)
    # At most one date per month of the backfill range.
    dates = [r.reference_datetime for r in todo.select("reference_datetime").distinct().toLocalIterator()]
    failures: list[DataFrame] = []
    errors: list[tuple[dt.date, str | None, str | None, str]] = []

    def run(places: list[int]) -> list[int]:
        forecast = _tagged(model, monthly, drivers, issue_dates(spark, [dates[i] for i in places]), variant)
        if "error" in forecast.columns:
            forecast = staged(forecast, "forecast")
            failed = forecast.where("error is not null")
            failures.append(failed.select(F.col("reference_datetime").alias("issue"), "site_id", "variable", F.col("error").alias("message")).distinct())
        write_forecast(_sound(forecast), path)
        return places

    if dates:
        monthly = staged(variant_series(daily, variant), "monthly")
        _, messages = isolated(run, len(dates))
        errors += [(date, None, None, message.splitlines()[0]) for date, message in zip(dates, messages) if message]
    failed = {date for date, *_ in errors}
    left = missing_issues(required_issues(spark, model, variant, start, end), stored_catalog(spark, path), cut)
    for row in left.select("reference_datetime").toLocalIterator():
        if row.reference_datetime not in failed:
            errors.append((row.reference_datetime, None, None, "no forecast generated"))
    return reduce(DataFrame.union, failures, spark.createDataFrame(errors, "issue date, site_id string, variable string, message string"))
