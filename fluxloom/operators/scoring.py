"""Probabilistic scoring of forecasts against observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.functions.dates import horizon_months
from fluxloom.functions.labels import MODEL_NAMES, model_type, recode
from fluxloom.functions.scores import crps_normal, log_score_normal
from fluxloom.operators.cleaning import exclude_models
from fluxloom.operators.joins import OBSERVATION_KEYS, join_treatments, observed_only

FORECAST_KEYS = (
    "project_id", "model_id", "datetime", "reference_datetime", "duration", "site_id", "family", "variable"
)


def to_distribution(df: DataFrame) -> DataFrame:
    """Two rows per forecast (mu and sigma) to one."""
    pick = lambda p: F.max(F.when(F.col("parameter") == p, F.col("prediction"))).alias(p)
    return df.groupBy(*FORECAST_KEYS).agg(pick("mu"), pick("sigma"))


def to_long(df: DataFrame) -> DataFrame:
    """One row per forecast to the two-row interchange layout."""
    wide = df.select(*FORECAST_KEYS, "mu", "sigma")
    return wide.unpivot(list(FORECAST_KEYS), ["mu", "sigma"], "parameter", "prediction")


def forecast_summary(df: DataFrame) -> DataFrame:
    """Mean, spread and lead in days of each forecast; leads after the issue date only."""
    lead = F.datediff("datetime", "reference_datetime")
    return df.withColumns({"mean": F.col("mu"), "sd": F.col("sigma"), "horizon": lead}).where(F.col("horizon") > 0)


def score_distributions(wide: DataFrame, obs: DataFrame) -> DataFrame:
    """Score one-row forecasts. The inner join is the prefilter: unobserved months are not scored."""
    observed = obs.where(F.col("observation").isNotNull()).select(*OBSERVATION_KEYS, "observation")
    mu, sigma, y = F.col("mu"), F.col("sigma"), F.col("observation")
    return wide.join(observed, list(OBSERVATION_KEYS)).withColumns(
        {
            "mean": mu,
            "sd": sigma,
            "crps": crps_normal(mu, sigma, y),
            "logs": log_score_normal(mu, sigma, y),
            "horizon": F.datediff("datetime", "reference_datetime"),
        }
    )


def score_all(forecasts: DataFrame, obs: DataFrame) -> DataFrame:
    """Score interchange forecasts (mu and sigma rows) that have an observation.

    The semi-join drops unobserved rows before the mu/sigma shuffle.
    """
    return score_distributions(to_distribution(observed_only(forecasts, obs)), obs)


def crps_ensemble(df: DataFrame, keys: Sequence[str], member="prediction", observation="observation") -> DataFrame:
    """CRPS of an ensemble from sorted ranks: mean distance to the observation less half the mean spread."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(member))
    ranked = df.withColumns({"_i": rank, "_m": F.count("*").over(w)})
    spread = F.sum((2 * F.col("_i") - F.col("_m") - 1) * F.col(member)) / F.max(F.col("_m") * F.col("_m"))
    distance = F.avg(F.abs(F.col(member) - F.col(observation)))
    return ranked.groupBy(*keys).agg((distance - spread).alias("crps"), F.count("*").alias("members"))


def format_scores(scores: DataFrame, treatments: DataFrame, year: int | Column) -> DataFrame:
    """Scores with rounded lead, treatments, model type and display names, for one target year."""
    kept = exclude_models(scores.where(F.col("horizon") > 0)).where(F.year("datetime") == year)
    named = kept.withColumn("horizon", horizon_months(F.col("reference_datetime"), F.col("datetime")))
    return join_treatments(named, treatments).withColumns(
        {
            "year": F.year("datetime"),
            "model_type": model_type(F.col("model_id")),
            "model_id": recode(F.col("model_id"), MODEL_NAMES),
        }
    )
