"""Monthly climatology."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.functions.dates import steps_to_issue
from fluxloom.operators.calendar import interpolate_linear
from fluxloom.plans.common import FITS, HORIZON, SERIES, finish_forecast, issue_array, placed, register_model


@register_model("climatology")
def fc_climatology(
    monthly: DataFrame,
    drivers: DataFrame | None,
    issues: DataFrame,
    horizon: int = HORIZON,
    inclusive: bool = True,
    least: int = 5,
) -> DataFrame:
    """Mean of the calendar month; one sigma per series, the median of the monthly deviations.

    The statistics of every issue date are running moments per calendar month. A row's moments hold
    from its own month until the next year's row, so each issue date picks exactly one row and no
    training set is built. ``inclusive`` trains on the issue month as well.
    """
    month = F.month("datetime")
    by_month = Window.partitionBy(*SERIES, month).orderBy("datetime")
    so_far = by_month.rowsBetween(Window.unboundedPreceding, 0)
    y = F.col("observation")
    moments = placed(monthly).withColumns(
        {
            "month": month,
            "n": F.count(y).over(so_far),
            "mean": F.avg(y).over(so_far),
            "sd": F.stddev_samp(y).over(so_far),
            "next": F.lead("datetime").over(by_month),
            "issues": issue_array(issues),
        }
    )
    d, following = F.col("datetime"), F.col("next")
    if inclusive:
        holds = lambda i: (i >= d) & (following.isNull() | (i < following))
    else:
        holds = lambda i: (i > d) & (following.isNull() | (i <= following))
    picked = moments.withColumn("issue", F.explode(F.filter("issues", holds)))
    table = F.map_from_entries(F.collect_list(F.struct("month", F.struct("mean", "sd"))))
    fits = picked.groupBy(*FITS).agg(
        table.alias("clim"), F.sum("n").alias("n"), F.max("datetime").alias("last")
    ).where(F.col("n") >= least)

    steps = F.sequence(F.lit(1), steps_to_issue(F.col("last"), F.col("issue"), horizon))
    ahead = F.transform(steps, lambda k: F.add_months(F.col("last"), k))
    cells = F.transform(
        ahead, lambda v: F.struct(v.alias("datetime"), F.try_element_at("clim", F.month(v)).alias("c"))
    )
    rows = fits.select(*FITS, F.explode(cells).alias("x")).select(
        *FITS, "x.datetime", F.col("x.c.mean").alias("mu"), F.col("x.c.sd").alias("sd")
    )
    by_fit = Window.partitionBy(*FITS)
    rows = rows.withColumns(
        {
            "sigma": F.percentile("sd", 0.5).over(by_fit),
            "means": F.count("mu").over(by_fit),
        }
    ).where((F.col("means") > 0) & F.col("sigma").isNotNull())
    return finish_forecast(interpolate_linear(rows, FITS, "datetime", "mu"), "climatology")
