"""Targets, drivers and treatment summaries.

Raw measurements reduce by partial aggregation before any shuffle. After ``monthly_targets`` a
series holds at most one row per month, so windows and arrays over one series are bounded by the
calendar, however many measurements there were.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.dates import month_floor
from fluxloom.functions.values import rep_group_code
from fluxloom.operators.cleaning import clean_flux, drop_null_targets, filter_years
from fluxloom.operators.joins import join_treatments, latest_issue
from fluxloom.operators.percentiles import exact_percentiles
from fluxloom.operators.reshape import pivot_wide, stack, unpivot_long

TARGET_KEYS = ("project_id", "site_id", "datetime", "duration", "variable")

# Names of the weather drivers in the interchange tables.
PREDICTORS = ("Temp_K", "SolarRad_Wm2", "PrecipRate_ms", "WindSpeed_ms", "Pressure_Pa")
DRIVER_VARIABLES = ("Temp_K", "Pressure_Pa", "SoilTemp_K", "SolarRad_Wm2", "PrecipRate_ms", "WindSpeed_ms")
# The target variable and its time step.
TARGET_VARIABLE = "CH4_slope_umol_m2_d"
DURATION = "P1M"


def format_targets(clean: DataFrame, project_id: str = "project") -> DataFrame:
    """Clean measurements in the long target layout, missing values and dates dropped."""
    wide = clean.select(
        F.lit(project_id).alias("project_id"),
        F.col("Plot").alias("site_id"),
        F.col("Date").alias("datetime"),
        F.lit(DURATION).alias("duration"),
        F.col("flux").alias(TARGET_VARIABLE),
    )
    return drop_null_targets(unpivot_long(wide, [TARGET_VARIABLE], "variable", "observation"))


def daily_targets(df: DataFrame, **percentile_options) -> DataFrame:
    """Median and number of measurements per site and day."""
    medians = exact_percentiles(
        df, TARGET_KEYS, "observation", {"observation": 0.5}, [F.count("*").alias("n")], **percentile_options
    )
    return medians.select(*TARGET_KEYS, "observation", "n")


def build_targets(raw: DataFrame, rules: DataFrame, lo: int, hi: int, project_id: str = "project") -> DataFrame:
    """Raw text measurements to the daily target table of the years ``lo`` to ``hi``."""
    long = format_targets(clean_flux(raw, rules), project_id)
    return daily_targets(filter_years(long, lo, hi))


def monthly_targets(daily: DataFrame, until: Column | None = None) -> DataFrame:
    """Mean per site and month. ``until`` keeps months that begin on or before it."""
    monthly = daily.withColumn("datetime", month_floor(F.col("datetime")))
    if until is not None:
        monthly = monthly.where(F.col("datetime") <= until)
    return monthly.groupBy(*TARGET_KEYS).agg(F.avg("observation").alias("observation"))


def monthly_targets_with_dates(daily: DataFrame) -> DataFrame:
    """Monthly means with the dates observed, at most 31 per month."""
    dated = daily.withColumn("observed", F.col("datetime")).withColumn("datetime", month_floor(F.col("datetime")))
    return dated.groupBy(*TARGET_KEYS).agg(
        F.avg("observation").alias("observation"),
        F.sort_array(F.collect_set("observed")).alias("dates_observed"),
    )


def rep_mean_targets(monthly: DataFrame) -> DataFrame:
    """Unweighted mean of plot means per replicate group and month."""
    grouped = monthly.withColumn("site_id", rep_group_code(F.col("site_id")))
    return grouped.groupBy(*TARGET_KEYS).agg(F.avg("observation").alias("observation"))


def all_targets(monthly: DataFrame) -> DataFrame:
    """Plot series and replicate-group series together."""
    return stack([monthly, rep_mean_targets(monthly)])


def past_driver_mean(drivers: DataFrame) -> DataFrame:
    """Ensemble mean of the lead-1 forecasts per month, one column per driver."""
    return pivot_wide(
        drivers.where(F.col("horizon") == 1), ["datetime"], "variable", "prediction", DRIVER_VARIABLES, F.avg
    )


def future_drivers(drivers: DataFrame, issues: DataFrame) -> DataFrame:
    """Latest ensemble at each issue date, one row per member and month.

    Duplicate cells are averaged, and ``cells`` counts the values behind each row.
    """
    latest = latest_issue(drivers, issues)
    keys = ["issue", "reference_datetime", "parameter", "horizon", "datetime"]
    columns = [F.avg(F.when(F.col("variable") == v, F.col("prediction"))).alias(v) for v in DRIVER_VARIABLES]
    return latest.groupBy(*keys).agg(F.count("*").alias("cells"), *columns)


def climatology_stats(monthly: DataFrame) -> DataFrame:
    """Mean and sample standard deviation per site and calendar month."""
    return monthly.groupBy("site_id", F.month("datetime").alias("month")).agg(
        F.avg("observation").alias("clim_mean"), F.stddev_samp("observation").alias("clim_sd")
    )


def treatment_spread(monthly: DataFrame, treatments: DataFrame) -> DataFrame:
    """Median and interquartile range of the lowest and highest warming level, rounded."""
    ends = join_treatments(monthly, treatments).where((F.col("CO2") == 0) & F.col("Temp").isin(0.0, 5.1))
    q = exact_percentiles(ends, ["Temp"], "observation", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return q.select("Temp", F.bround("q2", 0).alias("median"), F.bround(F.col("q3") - F.col("q1"), 0).alias("iqr"))


def treatment_extremes(monthly: DataFrame, treatments: DataFrame, month: int = 8, veg: str = "C3") -> DataFrame:
    """Smallest and largest value of a calendar month per warming level, rounded."""
    rows = join_treatments(monthly, treatments).where(
        (F.month("datetime") == month) & (F.col("Veg") == veg) & (F.col("CO2") == 0) & F.col("Temp").isin(0.0, 5.1)
    )
    return rows.groupBy("Temp").agg(
        F.bround(F.min("observation"), 0).alias("min"), F.bround(F.max("observation"), 0).alias("max")
    )


def range_of_site_medians(monthly: DataFrame, treatments: DataFrame) -> DataFrame:
    """Spread of the site medians per warming level. A site's series is bounded, so its median is too."""
    medians = monthly.groupBy("site_id").agg(F.median("observation").alias("median"))
    rows = join_treatments(medians, treatments).where((F.col("CO2") == 0) & F.col("Temp").isin(0.0, 5.1))
    out = rows.groupBy("Temp").agg(
        F.bround(F.min("median"), 0).alias("min"), F.bround(F.max("median"), 0).alias("max")
    )
    return out.withColumn("range", F.col("max") - F.col("min"))


def box_summary(df: DataFrame, by: Sequence[str], column: str, **percentile_options) -> DataFrame:
    """Quartiles and whiskers: the outermost points within 1.5 interquartile ranges of the box."""
    q = exact_percentiles(
        df, by, column, {"lower": 0.25, "middle": 0.5, "upper": 0.75}, [F.count(column).alias("n")],
        **percentile_options,
    )
    fence = (F.col("upper") - F.col("lower")) * 1.5
    inside = F.col(column).between(F.col("lower") - fence, F.col("upper") + fence)
    return (
        # A null key is a group of its own, as in the percentiles.
        df.select(*by, column)
        .join(
            q.withColumnsRenamed({k: f"_{k}" for k in by}),
            reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by], F.lit(True)),
        )
        .where(inside)
        .groupBy(*by, "lower", "middle", "upper", "n")
        .agg(F.min(column).alias("ymin"), F.max(column).alias("ymax"))
    )
