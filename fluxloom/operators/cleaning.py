"""Quality rules and row predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.functions.dates import parse_mixed_date
from fluxloom.functions.labels import OBSOLETE_MODELS, TEMPERATURE_LEVELS, recode
from fluxloom.functions.values import to_double_or_null
from fluxloom.operators.reshape import stack
from fluxloom.session import broadcast_if_small


def apply_exclusions(df: DataFrame, rules: DataFrame, date="Date", plot="Plot", value="flux") -> DataFrame:
    """Null the value on listed dates. A rule names a plot, or with a null plot all plots.

    Rules fold to one row per date first, so the join is one-to-many on the date alone and can
    never duplicate a measurement.
    """
    by_date = rules.groupBy(F.col("date").alias("_date")).agg(
        F.max(F.col("plot").isNull()).alias("_all"), F.collect_set("plot").alias("_plots")
    )
    hit = F.col("_all") | F.array_contains("_plots", F.col(plot))
    joined = df.join(broadcast_if_small(by_date), F.col(date) == F.col("_date"), "left")
    return joined.withColumn(
        value, F.when(F.coalesce(hit, F.lit(False)), F.lit(None)).otherwise(F.col(value))
    ).select(df.columns)


def filter_dark(df: DataFrame, light="Light") -> DataFrame:
    return df.where(F.col(light).isNull() | F.col(light).isin("Dark"))


def drop_null_targets(df: DataFrame, value="observation", date="datetime") -> DataFrame:
    return df.dropna(subset=[value, date])


def filter_years(df: DataFrame, lo: int, hi: int, date="datetime") -> DataFrame:
    """Inclusive year range as a plain date range, so that file statistics can prune."""
    first, last = F.lit(f"{lo}-01-01").cast("date"), F.lit(f"{hi}-12-31").cast("date")
    return df.where(F.col(date).between(first, last))


def exclude_year(df: DataFrame, year: int, date="datetime") -> DataFrame:
    """All but one year, as plain date ranges, so that file statistics can prune."""
    first, after = F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year + 1}-01-01").cast("date")
    return df.where((F.col(date) < first) | (F.col(date) >= after))


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop a row with a null in any column, used by the model or not."""
    return df.dropna("any")


def min_rows_per_key(df: DataFrame, keys: Sequence[str], column: str, n: int) -> DataFrame:
    """Rows of keys with at least ``n`` non-null values. Keys are bounded monthly series."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_n", F.count(column).over(w)).where(F.col("_n") >= n).drop("_n")


def exclude_models(df: DataFrame, models: Sequence[str] = OBSOLETE_MODELS) -> DataFrame:
    """Drop listed models; a missing model name stays."""
    return df.where(~F.coalesce(F.col("model_id").isin(*models), F.lit(False)))


def sentinel_to_null(df: DataFrame, column: str, sentinel: float = -99) -> DataFrame:
    """Drop rows holding the missing-value sentinel, and rows already null."""
    return df.where(F.col(column) != F.lit(sentinel))


def clean_porewater(vintages: Sequence[DataFrame], depth: int = 20, co2: int = 0) -> DataFrame:
    """Stack survey vintages, recode the warming level, keep one depth, build the sampling date."""
    parts = []
    for df in vintages:
        df = df.withColumnRenamed("umol_CH4", "CH4")
        parts.append(df.withColumn("Temperature", recode(F.col("Temperature").cast("int"), TEMPERATURE_LEVELS)))
    out = sentinel_to_null(stack(parts), "CH4")
    text = F.concat_ws(" ", "Year", "Month", "Day")
    return out.where((F.col("CO2") == co2) & (F.col("Depth") == depth)).withColumn(
        "datetime", F.try_to_date(text, "yyyy MMMM d")
    )


def parse_flux(raw: DataFrame) -> DataFrame:
    """Text columns ``Date`` and ``flux`` to date and double.

    The values pass through a one-element array: filters on them stay above it, so that the texts
    are parsed once per row and not again for each filter pushed towards the scan.
    """
    parsed = F.struct(
        parse_mixed_date(F.col("Date")).alias("Date"), to_double_or_null(F.col("flux")).alias("flux")
    )
    others = [c for c in raw.columns if c not in ("Date", "flux")]
    return raw.select(*others, F.inline(F.array(parsed)))


def clean_flux(raw: DataFrame, rules: DataFrame) -> DataFrame:
    """Parse text measurements, apply the quality rules and keep dark chambers."""
    return filter_dark(apply_exclusions(parse_flux(raw), rules)).select("Date", "Plot", "flux")
