"""Joins of series with drivers, treatments, observations and the forecast catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.operators.reshape import stack
from fluxloom.session import broadcast_if_small

OBSERVATION_KEYS = ("project_id", "site_id", "datetime", "duration", "variable")


def join_drivers(targets: DataFrame, drivers: DataFrame) -> DataFrame:
    """Left join on the month; drivers hold one row per month."""
    return targets.join(broadcast_if_small(drivers), "datetime", "left")


def join_treatments(df: DataFrame, treatments: DataFrame) -> DataFrame:
    """Left join of the treatment table on the plot code, compared as text."""
    table = treatments.withColumn("_site", F.col("Plot").cast("string")).drop("Plot")
    return df.join(broadcast_if_small(table), F.col("site_id") == F.col("_site"), "left").drop("_site")


def load_treatments(plots: DataFrame) -> DataFrame:
    """Plot rows plus one row per replicate group, which has no transect."""
    plots = plots.withColumn("Plot", F.col("Plot").cast("string"))
    groups = plots.withColumn("Plot", F.concat(F.substring("Plot", 1, 1), F.substring("Plot", 3, 1)))
    groups = groups.drop("Transect").withColumn("Type", F.lit("Rep_comb")).distinct()
    return stack([plots.withColumn("Type", F.lit("Separate")), groups])


def observed_only(forecasts: DataFrame, obs: DataFrame, keys: Sequence[str] = OBSERVATION_KEYS) -> DataFrame:
    """Forecast rows that have an observation to be scored against."""
    return forecasts.join(obs.where(F.col("observation").isNotNull()).select(*keys), list(keys), "left_semi")


def full_calendar_join(clim: DataFrame, months: DataFrame, keys=("month", "site_id")) -> DataFrame:
    """Every calendar month present, then de-duplicated."""
    return clim.join(months, list(keys), "full_outer").distinct()


def clim_to_dates(clim: DataFrame, dates: DataFrame, keys=("month",)) -> DataFrame:
    """Full outer join of monthly values to the requested dates on the month number."""
    return clim.join(dates, list(keys), "full_outer")


def missing_issues(required: DataFrame, catalog: DataFrame, cutoff: Column) -> DataFrame:
    """Required keys absent from the catalogue, or present only with older output than the cut-off."""
    keys = [c for c in required.columns if c in catalog.columns]
    return required.join(catalog.where(F.col("modified_at") >= cutoff), keys, "left_anti")


def with_group_reference(df: DataFrame, keys: Sequence[str], is_reference: Column, value: str, name: str) -> DataFrame:
    """Each row beside the value of the one row of its group that satisfies a predicate."""
    w = Window.partitionBy(*keys)
    return df.withColumn(name, F.max(F.when(is_reference, F.col(value))).over(w))


def latest_issue(df: DataFrame, issues: DataFrame, reference="reference_datetime") -> DataFrame:
    """For each issue date the rows of the latest reference date not after it.

    Reference dates are few (one per month), so they travel as one array; the data then joins on
    equality. ``issues`` has one column ``issue``.
    """
    refs = df.select(F.col(reference).alias("r")).distinct().agg(F.collect_set("r"))
    chosen = issues.withColumn("_refs", refs.scalar()).withColumn(
        "_ref", F.array_max(F.filter("_refs", lambda r: r <= F.col("issue")))
    )
    chosen = chosen.where(F.col("_ref").isNotNull()).select("issue", "_ref")
    return df.join(broadcast_if_small(chosen), F.col(reference) == F.col("_ref")).drop("_ref")
