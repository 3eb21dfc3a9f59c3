"""What every forecast model shares."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.operators.aggregates import DURATION
from fluxloom.operators.cleaning import min_rows_per_key
from fluxloom.operators.calendar import filled_series

#: A series: site and variable, with the project tag carried along.
SERIES = ("project_id", "site_id", "variable")
FITS = (*SERIES, "issue")
#: Rows are placed by these alone: a project tag is often a constant, which Catalyst drops from keys.
PLACEMENT = ("site_id", "variable")
HORIZON = 6
#: Fixed value: upper 84 % point of the standard normal, the half width of a 68 % band.
BAND_68 = 0.994457883209753

FORECAST_COLUMNS = (
    "project_id", "model_id", "datetime", "reference_datetime", "duration", "site_id", "family",
    "variable", "mu", "sigma",
)


def issue_array(issues: DataFrame) -> Column:
    """All issue dates as one sorted array: at most one per calendar month, so it is small."""
    return issues.agg(F.sort_array(F.collect_set("issue"))).scalar()


def placed(df: DataFrame) -> DataFrame:
    """Rows dealt by series over a stated number of partitions.

    Fits cost time, not bytes: without the number, adaptive execution would put small series into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PLACEMENT)


def issue_lookup(table: DataFrame, value: str) -> Column:
    """A column of a table with one row per issue date, looked up by the row's own ``issue``; null where absent.

    Such tables are bounded by the calendar, so they travel as one map; a join would have the issue date as its
    only key, which Catalyst folds away for a single date.
    """
    entries = table.agg(F.map_from_entries(F.collect_list(F.struct("issue", value)))).scalar()
    return F.try_element_at(entries, F.col("issue"))


def training_window(monthly: DataFrame, issues: DataFrame, inclusive: bool = False) -> DataFrame:
    """For each issue date the rows before it (or up to it), with the date in ``issue``.

    Rows are placed by series first; every window and aggregate of a model is keyed by series and
    issue date and reuses that placement.
    """
    rows = placed(monthly).withColumn("_issues", issue_array(issues))
    d = F.col("datetime")
    use = F.filter("_issues", lambda i: (i >= d) if inclusive else (i > d))
    return rows.withColumn("issue", F.explode(use)).drop("_issues")


def fan_out_keys(monthly: DataFrame) -> DataFrame:
    """One row per fit: every variable and site with its number of months."""
    return monthly.groupBy(*SERIES).agg(F.count("observation").alias("months"))


def target_variables(df: DataFrame, variables: DataFrame) -> DataFrame:
    """Keep only the variables listed for forecasting."""
    wanted = variables.select(F.col("target").alias("variable")).distinct()
    return df.join(wanted, "variable", "left_semi")


def training_series(monthly: DataFrame, issues: DataFrame, least: int = 5) -> DataFrame:
    """Gap-free training rows per series and issue date, series below ``least`` values skipped."""
    rows = min_rows_per_key(training_window(monthly, issues), FITS, "observation", least)
    return filled_series(rows, FITS)


def series_arrays(rows: DataFrame, keys: Sequence[str] = FITS, value="observation") -> DataFrame:
    """One row per fit: values in date order and the last date. Bounded by the calendar."""
    packed = F.sort_array(F.collect_list(F.struct("datetime", value)))
    return rows.groupBy(*keys).agg(
        F.transform(packed, lambda s: s[value]).alias("y"),
        F.max("datetime").alias("last"),
        F.count("*").cast("int").alias("size"),
    )


def finish_forecast(df: DataFrame, model_id: str) -> DataFrame:
    """Tag the model and keep months from the issue date on. Expects FITS, datetime, mu and sigma.

    A column ``error``, where a model has one, goes along: it names why a fit has no values.
    """
    error = carried(df, "error")
    if error:
        df = df.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in ("mu", "sigma")})
    return (
        df.where(F.col("datetime") >= F.col("issue"))
        .withColumns(
            {
                "model_id": F.lit(model_id),
                "reference_datetime": F.col("issue"),
                "duration": F.lit(DURATION),
                "family": F.lit("normal"),
            }
        )
        .select(*FORECAST_COLUMNS, *error)
    )


def carried(df: DataFrame, *columns: str) -> list[str]:
    """Those of the columns that ``df`` has."""
    return [c for c in columns if c in df.columns]


# fn(monthly targets, long drivers, issue dates) -> wide forecast
MODELS: dict[str, Callable[[DataFrame, DataFrame | None, DataFrame], DataFrame]] = {}


def register_model(name: str, fn: Callable | None = None):
    """Make a model function known to the runs; usable as a decorator."""
    if fn is None:
        return lambda f: register_model(name, f)
    MODELS[name] = fn
    return fn
