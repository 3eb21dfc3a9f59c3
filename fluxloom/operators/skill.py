"""Skill metrics by treatment and the comparison tables built from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.functions import metrics as m
from fluxloom.functions.dates import pseudo_year_date
from fluxloom.functions.labels import (
    CO2_LABELS,
    METRIC_LABELS,
    VEGETATION_CODES,
    VEGETATION_LABELS,
    ordinal,
    paste,
    recode,
    temperature_label,
)
from fluxloom.functions.values import fold_transect, ratio
from fluxloom.operators.cleaning import clean_porewater
from fluxloom.operators.joins import join_treatments, with_group_reference
from fluxloom.operators.percentiles import exact_percentiles
from fluxloom.operators.reshape import unpivot_long

SKILL_KEYS = ("horizon", "site_id", "model_id", "Temp", "year", "CO2Treat", "Veg")


def _ambient(scores: DataFrame, horizon: int = 6, kind: str | None = "Separate") -> DataFrame:
    rows = scores.where((F.col("horizon") == horizon) & (F.col("CO2Treat") == "Amb"))
    return rows if kind is None else rows.where(F.col("Type") == kind)


def skill(
    scores: DataFrame,
    metrics: Mapping[str, Column],
    by: Sequence[str] = SKILL_KEYS,
    horizon: int = 6,
    kind: str | None = "Separate",
) -> DataFrame:
    """Metrics per group of the ambient plots at one lead."""
    return _ambient(scores, horizon, kind).groupBy(*by).agg(
        *[c.alias(name) for name, c in metrics.items()], F.count("*").alias("n")
    )


def metric_columns() -> dict[str, Column]:
    """Every skill metric over the score columns."""
    obs, fc = F.col("observation"), F.col("mean")
    return {
        "bias": m.bias(obs, fc),
        "crps": F.avg("crps"),
        "grmse": m.geometric_rmse(obs, fc),
        "r2_11": m.r2_one_to_one(obs, fc),
        "r2": m.r2_regression(obs, fc),
        "sd": F.avg("sd"),
        "ign": F.avg("logs"),
        "rmse_mean": m.rmse_over_mean(obs, fc),
        "grmse_mean": m.grmse_over_gmean(obs, fc),
        "rmse": m.rmse(obs, fc),
    }


def rmse_table(scores: DataFrame, **options) -> DataFrame:
    return skill(scores, {"rmse": m.rmse(F.col("observation"), F.col("mean"))}, **options)


def rmse_rep_comb(scores: DataFrame) -> DataFrame:
    """RMSE of the replicate-group forecasts."""
    return rmse_table(scores, kind="Rep_comb")


def metric_table(scores: DataFrame) -> DataFrame:
    """Seven metrics as rows with display names and display order."""
    wanted = ["crps", "bias", "grmse", "r2", "rmse_mean", "ign", "sd"]
    columns = metric_columns()
    wide = skill(scores, {k: columns[k] for k in wanted}).drop("n")
    long = unpivot_long(wide, wanted)
    return long.withColumns(
        {"rank": ordinal(F.col("name"), METRIC_LABELS), "name": recode(F.col("name"), METRIC_LABELS)}
    )


def median_rmse_by_treatment(scores: DataFrame, veg: str | None = None) -> DataFrame:
    """Median over sites and models of the RMSE per warming level, with its ratio to the ambient level."""
    per_series = rmse_table(scores)
    if veg is not None:
        per_series = per_series.where(F.col("Veg") == veg)
    keys = ["horizon", "Temp", "year", "CO2Treat"]
    medians = exact_percentiles(per_series, keys, "rmse", {"rmse": 0.5}, [F.count("*").alias("series")])
    base = with_group_reference(medians, ["horizon", "year", "CO2Treat"], F.col("Temp") == 0, "rmse", "_base")
    return base.withColumn("ratio", ratio(F.col("rmse"), F.col("_base"))).drop("_base")


def rmse_change_from_averaging(scores: DataFrame) -> DataFrame:
    """Percent change of RMSE when replicates are averaged before forecasting."""
    keys = ["horizon", "model_id", "Temp", "CO2Treat", "Veg"]
    table = rmse_table(scores, by=[*keys, "Type"], kind=None)
    paired = with_group_reference(table, keys, F.col("Type") == "Rep_comb", "rmse", "_rep")
    change = ratio(F.col("_rep") - F.col("rmse"), F.col("rmse")) * 100
    return (
        paired.where(F.col("Type") != "Rep_comb")
        .withColumns({"rmse": change, "Veg": recode(F.col("Veg"), VEGETATION_LABELS)})
        .drop("_rep")
    )


def mean_rmse_change(scores: DataFrame) -> DataFrame:
    """Mean of that change overall (null keys) and by warming level and vegetation, in one aggregation."""
    change = rmse_change_from_averaging(scores)
    return (
        change.groupingSets([[], ["Temp", "Veg"]], "Temp", "Veg")
        .agg(F.avg("rmse").alias("rmse_change"), F.grouping_id().alias("_level"))
        .withColumn("scope", F.when(F.col("_level") == 0, "by treatment").otherwise("overall"))
        .drop("_level")
    )


def _display(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "Veg": recode(F.col("Veg"), VEGETATION_LABELS),
            "CO2Treat": recode(F.col("CO2Treat"), CO2_LABELS),
            "Temp": temperature_label(F.col("Temp")),
            "Transect": fold_transect(F.col("Transect")),
        }
    )


def observation_overlay(monthly: DataFrame, treatments: DataFrame, year: int) -> DataFrame:
    """Observation series laid over one pseudo year, the forecast year marked."""
    rows = _display(join_treatments(monthly, treatments).where(F.col("CO2") == 0))
    return rows.withColumns(
        {
            "year": F.year("datetime"),
            "yday": pseudo_year_date(F.col("datetime")),
            "line": paste(F.year("datetime"), F.col("site_id")),
            "forecast_year": F.year("datetime") == year,
        }
    )


def forecast_overlay(scores: DataFrame) -> DataFrame:
    """Six-month forecast and observation by plot and model."""
    rows = scores.where((F.col("Type") == "Separate") & (F.col("horizon") == 6) & (F.col("CO2") == 0))
    return _display(rows).withColumn("mod", paste(F.col("model_id"), F.col("site_id"), sep=" "))


def porewater_overlay(vintages: Sequence[DataFrame]) -> DataFrame:
    """Porewater series by plot and year laid over one pseudo year."""
    rows = clean_porewater(vintages)
    return rows.withColumns(
        {
            "Veg": recode(F.col("Vegetation").cast("string"), VEGETATION_CODES),
            "Temp": F.concat(paste(F.col("Temperature")), F.lit("~degree*C")),
            "year": F.year("datetime"),
            "yday": pseudo_year_date(F.col("datetime")),
            "line": paste(F.year("datetime"), F.col("Plot")),
        }
    )


def plot_window(monthly: DataFrame, forecast: DataFrame, issue, horizon: int = 6) -> DataFrame:
    """Forecast band and the observations within ``horizon`` x 30 days of the issue date."""
    day = F.lit(issue).cast("date")
    near = monthly.where(
        F.col("datetime").between(F.date_sub(day, horizon * 30), F.date_add(day, horizon * 30))
    ).select("site_id", "datetime", "observation")
    band = forecast.where(F.col("reference_datetime") == day).select(
        "site_id", "datetime", "mu", (F.col("mu") - F.col("sigma")).alias("ymin"), (F.col("mu") + F.col("sigma")).alias("ymax")
    )
    return band.join(near, ["site_id", "datetime"], "full_outer").withColumn("ahead", F.col("datetime") >= day)
