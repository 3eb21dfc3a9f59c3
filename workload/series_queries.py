"""Joins, aggregates, calendar, windows and series statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.operators import aggregates as agg
from fluxloom.operators import calendar as cal
from fluxloom.operators import joins, reshape, series
from fluxloom.operators.percentiles import exact_percentiles
from fluxloom.plans.runs import required_issues
from workload.registry import query, rounded, sql_rounded as R
from workload.views import BACKFILL, CALENDAR, CATALOG_CUTOFF, ISSUE
from workload.views_sql import with_views


def rounds(df, *columns, digits=4):
    return df.withColumns({c: rounded(c, digits) for c in columns})


DRIVERS = ("Temp_K", "Pressure_Pa", "SoilTemp_K", "SolarRad_Wm2", "PrecipRate_ms", "WindSpeed_ms")
R_DRIVERS = ", ".join(f"{R(c)} AS {c}" for c in DRIVERS)

# ---- joins ------------------------------------------------------------------------------------


@query(
    "join_drivers",
    with_views(f"SELECT m.site_id, m.datetime, {R('observation')} AS observation, {R_DRIVERS} FROM monthly m LEFT JOIN past_drivers p USING (datetime)", "monthly", "past_drivers"),
)
def _(v):
    rows = joins.join_drivers(v.monthly, agg.past_driver_mean(v.drivers))
    return rounds(rows.select("site_id", "datetime", "observation", *DRIVERS), "observation", *DRIVERS)


@query(
    "join_treatments",
    with_views(f"SELECT m.site_id, datetime, {R('observation')} AS observation, Treat, Temp, Veg, CO2, CO2Treat, Transect, Type FROM all_monthly m LEFT JOIN treatments t ON m.site_id = t.Plot", "all_monthly", "treatments"),
)
def _(v):
    rows = joins.join_treatments(v.all_monthly, v.treatments).drop("project_id", "duration", "variable")
    return rounds(rows, "observation")


@query(
    "observed_only",
    with_views(
        """SELECT f.project_id, model_id, f.datetime, reference_datetime, f.site_id, parameter FROM forecasts f
           WHERE EXISTS (SELECT 1 FROM all_monthly o WHERE o.site_id = f.site_id AND o.datetime = f.datetime AND o.observation IS NOT NULL)""",
        "forecasts", "all_monthly",
    ),
)
def _(v):
    rows = joins.observed_only(v.forecasts, v.all_monthly)
    return rows.select("project_id", "model_id", "datetime", "reference_datetime", "site_id", "parameter")


CLIM_SQL = "SELECT site_id, month(datetime)::INTEGER AS month, avg(observation) AS clim_mean, stddev_samp(observation) AS clim_sd FROM train GROUP BY ALL"


def _clim(v):
    return agg.climatology_stats(v.until_issue())


def _all_months(v):
    sites = v.until_issue().select("site_id").distinct()
    return sites.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))


@query(
    "full_calendar_join",
    with_views(
        f"""SELECT site_id, month, {R('clim_mean')} AS clim_mean, {R('clim_sd')} AS clim_sd FROM
              (SELECT site_id, unnest(range(1, 13))::INTEGER AS month FROM (SELECT DISTINCT site_id FROM train)) a
              LEFT JOIN ({CLIM_SQL}) b USING (site_id, month)""",
        "train",
    ),
)
def _(v):
    return rounds(joins.full_calendar_join(_clim(v), _all_months(v)), "clim_mean", "clim_sd")


@query(
    "clim_to_dates",
    with_views(
        f"""SELECT month, d.datetime, c.site_id, {R('clim_mean')} AS clim_mean FROM ({CLIM_SQL}) c FULL JOIN
              (SELECT DISTINCT datetime, month(datetime)::INTEGER AS month FROM monthly WHERE datetime BETWEEN DATE '2000-07-01' AND DATE '2001-01-01') d
              USING (month)""",
        "train", "monthly",
    ),
)
def _(v):
    ahead = v.monthly.where(F.col("datetime").between(F.lit(ISSUE), F.add_months(F.lit(ISSUE), 6)))
    wanted = ahead.select("datetime", F.month("datetime").alias("month")).distinct()
    return rounds(joins.clim_to_dates(_clim(v).drop("clim_sd"), wanted), "clim_mean")


@query(
    "missing_issues",
    with_views(
        """SELECT 'climatology' AS model_id, d AS reference_datetime, 'separate' AS variant, count(o.d) AS orders FROM
             (SELECT unnest(generate_series(DATE '1999-01-01', DATE '2001-01-01', INTERVAL 1 MONTH))::DATE AS d) r
             LEFT JOIN (SELECT date_trunc('month', o_orderdate)::DATE AS d FROM orders) o USING (d)
           WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.model_id = 'climatology' AND c.variant = 'separate'
                             AND c.reference_datetime = r.d AND c.modified_at >= TIMESTAMP '2001-02-01') GROUP BY d""",
        "catalog",
    ),
)
def _(v):
    """Missing issue dates with the number of orders placed in their month, which may be none."""
    required = required_issues(v.spark, "climatology", "separate", *BACKFILL)
    todo = joins.missing_issues(required, v.catalog, F.lit(str(CATALOG_CUTOFF)).cast("timestamp"))
    placed = v.table("orders").groupBy(F.trunc("o_orderdate", "MM").alias("reference_datetime")).agg(F.count("*").alias("orders"))
    return todo.join(placed, "reference_datetime", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))


@query(
    "with_group_reference",
    with_views(
        f"""SELECT t.Temp, t.Veg, m.datetime, m.site_id, {R('m.observation')} AS observation,
              {R("max(CASE WHEN length(m.site_id) = 2 THEN m.observation END) OVER (PARTITION BY substr(m.site_id, 1, 1) || right(m.site_id, 1), m.datetime)")} AS reference
            FROM all_monthly m JOIN treatments t ON m.site_id = t.Plot""",
        "all_monthly", "treatments",
    ),
)
def _(v):
    rows = joins.join_treatments(v.all_monthly, v.treatments).where(F.col("Temp").isNotNull())
    group = F.concat(F.substring("site_id", 1, 1), F.right("site_id", F.lit(1)))
    rows = rows.withColumn("g", group)
    out = joins.with_group_reference(rows, ["g", "datetime"], F.length("site_id") == 2, "observation", "reference")
    return rounds(out.select("Temp", "Veg", "datetime", "site_id", "observation", "reference"), "observation", "reference")


@query(
    "latest_issue",
    with_views(
        """SELECT i AS issue, horizon, reference_datetime, parameter, datetime FROM driver_cells d JOIN
             (SELECT i, max(r) AS r FROM (SELECT unnest(generate_series(DATE '1999-01-01', DATE '2001-01-01', INTERVAL 1 MONTH))::DATE AS i)
              JOIN (SELECT DISTINCT reference_datetime AS r FROM driver_cells) ON r <= i GROUP BY i) x ON d.reference_datetime = x.r""",
        "driver_cells",
    ),
)
def _(v):
    rows = joins.latest_issue(v.driver_cells, v.backfill_issues)
    return rows.select("issue", "horizon", "reference_datetime", "parameter", "datetime")


# ---- aggregates -------------------------------------------------------------------------------


@query("daily_targets", with_views(f"SELECT project_id, site_id, datetime, duration, variable, {R('observation')} AS observation, n FROM daily", "daily"))
def _(v):
    return rounds(v.daily, "observation")


@query("daily_targets_bracketed", with_views(f"SELECT project_id, site_id, datetime, duration, variable, {R('observation')} AS observation, n FROM daily", "daily"))
def _(v):
    """The large-input way of the same medians: every group of two or more counts as hot."""
    return rounds(agg.daily_targets(v.long, hot_rows=1, accuracy=100), "observation")


@query(
    "exact_percentiles",
    f"""SELECT l_returnflag, count(*) AS n, {R('quantile_cont(l_extendedprice, 0.1)')} AS p10, {R('quantile_cont(l_extendedprice, 0.5)')} AS p50,
          {R('quantile_cont(l_extendedprice, 0.99)')} AS p99 FROM lineitem GROUP BY l_returnflag""",
)
def _(v):
    """Three hot groups, bracketed: about a third of all rows each."""
    q = exact_percentiles(
        v.table("lineitem"), ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p99": 0.99},
        [F.count("*").alias("n")], hot_rows=1000, accuracy=1000,
    )
    return rounds(q, "p10", "p50", "p99")


@query("monthly_targets", with_views(f"SELECT project_id, site_id, datetime, duration, variable, {R('observation')} AS observation FROM monthly WHERE datetime <= DATE '2000-07-01'", "monthly"))
def _(v):
    return rounds(agg.monthly_targets(v.daily, F.lit(ISSUE)), "observation")


@query(
    "monthly_targets_with_dates",
    with_views(
        f"""SELECT site_id, date_trunc('month', datetime)::DATE AS datetime, {R('avg(observation)')} AS observation,
              string_agg(strftime(datetime, '%d'), ',' ORDER BY datetime) AS dates, count(*) AS n_dates FROM daily GROUP BY 1, 2""",
        "daily",
    ),
)
def _(v):
    rows = agg.monthly_targets_with_dates(v.daily)
    days = F.array_join(F.transform("dates_observed", lambda d: F.date_format(d, "dd")), ",")
    return rows.select("site_id", "datetime", rounded("observation").alias("observation"), days.alias("dates"), F.size("dates_observed").cast("long").alias("n_dates"))


@query("rep_mean_targets", with_views(f"SELECT site_id, datetime, {R('observation')} AS observation FROM rep_monthly", "rep_monthly"))
def _(v):
    return rounds(agg.rep_mean_targets(v.monthly).select("site_id", "datetime", "observation"), "observation")


@query("all_targets", with_views(f"SELECT site_id, datetime, {R('observation')} AS observation FROM all_monthly", "all_monthly"))
def _(v):
    return rounds(v.all_monthly.select("site_id", "datetime", "observation"), "observation")


@query("past_driver_mean", with_views(f"SELECT datetime, {R_DRIVERS} FROM past_drivers", "past_drivers"))
def _(v):
    return rounds(agg.past_driver_mean(v.drivers), *DRIVERS)


@query("future_drivers", with_views(f"SELECT issue, reference_datetime, parameter, horizon, datetime, 6 AS cells, {R_DRIVERS} FROM future", "future"))
def _(v):
    rows = agg.future_drivers(v.drivers, v.issues)
    return rounds(rows.withColumn("cells", F.col("cells").cast("int")), *DRIVERS)


@query("climatology_stats", with_views(f"SELECT site_id, month, {R('clim_mean')} AS clim_mean, {R('clim_sd')} AS clim_sd FROM ({CLIM_SQL})", "train"))
def _(v):
    return rounds(_clim(v), "clim_mean", "clim_sd")


@query(
    "treatment_spread",
    with_views(
        """SELECT Temp, round_even(quantile_cont(observation, 0.5), 0) AS median,
             round_even(quantile_cont(observation, 0.75) - quantile_cont(observation, 0.25), 0) AS iqr
           FROM monthly m JOIN treatments t ON m.site_id = t.Plot WHERE CO2 = 0 AND Temp IN (0, 5.1) GROUP BY Temp""",
        "monthly", "treatments",
    ),
)
def _(v):
    return agg.treatment_spread(v.monthly, v.treatments)


@query(
    "treatment_extremes",
    with_views(
        """SELECT Temp, round_even(min(observation), 0) AS min, round_even(max(observation), 0) AS max
           FROM monthly m JOIN treatments t ON m.site_id = t.Plot
           WHERE month(datetime) = 8 AND Veg = 'C3' AND CO2 = 0 AND Temp IN (0, 5.1) GROUP BY Temp""",
        "monthly", "treatments",
    ),
)
def _(v):
    return agg.treatment_extremes(v.monthly, v.treatments)


@query(
    "range_of_site_medians",
    with_views(
        """SELECT Temp, round_even(min(md), 0) AS min, round_even(max(md), 0) AS max, round_even(max(md), 0) - round_even(min(md), 0) AS "range"
           FROM (SELECT site_id, median(observation) AS md FROM monthly GROUP BY 1) m JOIN treatments t ON m.site_id = t.Plot
           WHERE CO2 = 0 AND Temp IN (0, 5.1) GROUP BY Temp""",
        "monthly", "treatments",
    ),
)
def _(v):
    return agg.range_of_site_medians(v.monthly, v.treatments)


BOX_SQL = """
    SELECT Temp, lower, middle, upper, n, min(observation) AS ymin, max(observation) AS ymax FROM b JOIN (
      SELECT Temp, quantile_cont(observation, 0.25) AS lower, quantile_cont(observation, 0.5) AS middle,
             quantile_cont(observation, 0.75) AS upper, count(observation) AS n FROM b GROUP BY Temp) q USING (Temp)
    WHERE observation BETWEEN lower - (upper - lower) * 1.5 AND upper + (upper - lower) * 1.5 GROUP BY ALL
"""


@query(
    "box_summary",
    with_views(
        "SELECT Temp, n, " + ", ".join(f"{R(c)} AS {c}" for c in ("lower", "middle", "upper", "ymin", "ymax"))
        + f" FROM ({BOX_SQL.replace('FROM b', 'FROM (SELECT Temp, observation FROM monthly m JOIN treatments t ON m.site_id = t.Plot) b')})",
        "monthly", "treatments",
    ),
)
def _(v):
    rows = joins.join_treatments(v.monthly, v.treatments).select("Temp", "observation")
    return rounds(agg.box_summary(rows, ["Temp"], "observation"), "lower", "middle", "upper", "ymin", "ymax")


@query("distinct", with_views("SELECT DISTINCT site_id, variable FROM monthly", "monthly"))
def _(v):
    return reshape.distinct_values(v.monthly, "site_id", "variable")


# ---- calendar ---------------------------------------------------------------------------------


@query("complete_site_months", with_views(f"SELECT site_id, datetime, {R('observation')} AS observation FROM sites_complete", "sites_complete"))
def _(v):
    return rounds(cal.complete_site_months(v.monthly, ["site_id"]), "observation")


@query(
    "complete_global_months",
    with_views(
        f"""SELECT site_id, datetime, {R('observation')} AS observation FROM (SELECT DISTINCT site_id FROM monthly) CROSS JOIN
              (SELECT unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 MONTH))::DATE AS datetime FROM monthly)
              LEFT JOIN monthly USING (site_id, datetime)""",
        "monthly",
    ),
)
def _(v):
    return rounds(cal.complete_global_months(v.monthly, ["site_id"]), "observation")


@query("complete_fixed_months", with_views(f"SELECT site_id, datetime, {R('observation')} AS observation FROM fixed_complete", "fixed_complete"))
def _(v):
    return rounds(cal.complete_fixed_months(v.monthly, ["site_id"], *CALENDAR), "observation")


@query(
    "fill_month_mean",
    with_views(f"SELECT site_id, datetime, {R('COALESCE(observation, avg(observation) OVER (PARTITION BY site_id, month(datetime)))')} AS observation FROM sites_complete", "sites_complete"),
)
def _(v):
    full = cal.complete_site_months(v.monthly, ["site_id"])
    return rounds(cal.fill_month_mean(full, ["site_id"]), "observation")


@query(
    "interpolate_linear",
    with_views(
        f"""SELECT site_id, datetime, {R('''CASE WHEN y IS NOT NULL THEN y WHEN ya IS NULL THEN yb WHEN yb IS NULL THEN ya
                ELSE ya + (yb - ya) * (CAST(k - ka AS DOUBLE) / (kb - ka)) END''')} AS observation
            FROM (SELECT *, max(CASE WHEN y IS NOT NULL THEN k END) OVER b AS ka, min(CASE WHEN y IS NOT NULL THEN k END) OVER a AS kb,
                    last_value(y IGNORE NULLS) OVER b AS ya, first_value(y IGNORE NULLS) OVER a AS yb
                  FROM (SELECT site_id, datetime, row_number() OVER (PARTITION BY site_id ORDER BY datetime) AS k,
                          CASE WHEN month(datetime) IN (1, 2, 3, 7) THEN NULL ELSE observation END AS y FROM fixed_complete)
                  WINDOW b AS (PARTITION BY site_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                         a AS (PARTITION BY site_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
        "fixed_complete",
    ),
)
def _(v):
    """Gaps of up to three months, at the start of the series too."""
    full = cal.complete_fixed_months(v.monthly, ["site_id"], *CALENDAR)
    holed = full.withColumn("observation", F.when(~F.month("datetime").isin(1, 2, 3, 7), F.col("observation")))
    return rounds(cal.interpolate_linear(holed, ["site_id"], "datetime", "observation"), "observation")


@query(
    "future_months",
    with_views("SELECT site_id, k::INTEGER AS step, (last + to_months(k::INTEGER))::DATE AS datetime FROM (SELECT site_id, max(datetime) AS last FROM train GROUP BY 1), (SELECT unnest(range(1, 7)) AS k)", "train"),
)
def _(v):
    return cal.future_months(v.until_issue(), ["site_id"], 6)


@query(
    "future_days_month_starts",
    with_views(
        """SELECT site_id, d::DATE AS datetime FROM (SELECT site_id, unnest(generate_series(max(datetime) + 1, DATE '2001-01-01', INTERVAL 1 DAY)) AS d
           FROM train GROUP BY site_id) WHERE day(d) = 1""",
        "train",
    ),
)
def _(v):
    return cal.future_days_month_starts(v.until_issue(), ["site_id"], F.lit(ISSUE))


@query(
    "issue_calendar",
    """SELECT issue, count(*) AS orders FROM (SELECT unnest(generate_series(DATE '1999-01-01', DATE '2001-01-01', INTERVAL 1 MONTH))::DATE AS issue)
       JOIN orders ON date_trunc('month', o_orderdate)::DATE = issue GROUP BY issue""",
)
def _(v):
    """Issue dates with the orders placed in their month."""
    placed = v.table("orders").groupBy(F.trunc("o_orderdate", "MM").alias("issue")).agg(F.count("*").alias("orders"))
    return v.backfill_issues.join(placed, "issue")


# ---- windows, sorts, sets ---------------------------------------------------------------------


@query(
    "group_aggregate_to_rows",
    with_views(f"SELECT site_id, datetime, {R('avg(observation) OVER (PARTITION BY site_id)')} AS mean, {R('max(observation) OVER (PARTITION BY site_id)')} AS top FROM monthly", "monthly"),
)
def _(v):
    rows = series.group_aggregate_to_rows(v.monthly, ["site_id"], {"mean": F.avg("observation"), "top": F.max("observation")})
    return rounds(rows.select("site_id", "datetime", "mean", "top"), "mean", "top")


@query(
    "global_aggregate_to_rows",
    with_views(f"SELECT site_id, datetime, {R('(SELECT min(observation) FROM monthly)')} AS lo, {R('(SELECT max(observation) FROM monthly)')} AS hi FROM monthly", "monthly"),
)
def _(v):
    rows = series.global_aggregate_to_rows(v.monthly, {"lo": F.min("observation"), "hi": F.max("observation")})
    return rounds(rows.select("site_id", "datetime", "lo", "hi"), "lo", "hi")


@query(
    "lag_embedding",
    with_views(
        "SELECT site_id, datetime, " + ", ".join(f"{R(f'lag(observation, {i}) OVER w')} AS x{i}" for i in range(4))
        + " FROM sites_complete WINDOW w AS (PARTITION BY site_id ORDER BY datetime)",
        "sites_complete",
    ),
)
def _(v):
    rows = series.lag_embedding(cal.complete_site_months(v.monthly, ["site_id"]), ["site_id"], "observation", 4)
    return rounds(rows.drop("observation"), *[f"x{i}" for i in range(4)])


@query("sort_by", with_views(f"SELECT site_id, datetime, {R('observation')} AS observation FROM monthly ORDER BY site_id, datetime", "monthly"))
def _(v):
    return reshape.sort_by(rounds(v.monthly.select("site_id", "datetime", "observation"), "observation"), "site_id", "datetime")


@query(
    "argmax_by",
    """SELECT c_nationkey, n AS c, top FROM (SELECT o_custkey % 12 AS n, c_nationkey, count(*) AS top,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, o_custkey % 12) AS k
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) WHERE k = 1""",
)
def _(v):
    counts = v.measured.groupBy("c_nationkey", (F.col("o_custkey") % 12).alias("c")).agg(F.count("*").alias("top"))
    return series.argmax_by(counts, ["c_nationkey"], "c", "top")


@query(
    "stack",
    with_views("SELECT Plot AS site_id, \"Date\" AS datetime, flux, NULL::VARCHAR AS note FROM clean UNION ALL SELECT Plot, NULL, NULL, Veg FROM site_dim", "clean", "site_dim"),
)
def _(v):
    a = v.clean.select(F.col("Plot").alias("site_id"), F.col("Date").alias("datetime"), "flux")
    return reshape.stack([a, v.plots.select(F.col("Veg").alias("note"), F.col("Plot").alias("site_id"))])


@query(
    "nest_rows",
    with_views(f"SELECT site_id, count(*) AS n, min(datetime) AS first, {R('arg_max(observation, datetime)')} AS latest FROM monthly GROUP BY site_id", "monthly"),
)
def _(v):
    nested = reshape.nest_rows(v.monthly, ["site_id"])
    last = F.element_at("series", -1)
    return nested.select(
        "site_id", F.size("series").cast("long").alias("n"), F.col("series")[0].datetime.alias("first"),
        rounded(last.observation).alias("latest"),
    )


# ---- series characterisation ------------------------------------------------------------------

ACF_SQL = """
    (sum(c * lag_{k}) / nullif(count(c * lag_{k}) + {k}, 0)) / nullif(avg(c * c), 0)
"""
LAGGED = """(SELECT *, lag(c, 1) OVER w AS lag_1, lag(c, 2) OVER w AS lag_2, lag(c, 12) OVER w AS lag_12 FROM
    (SELECT *, observation - avg(observation) OVER (PARTITION BY site_id) AS c FROM fixed_complete)
    WINDOW w AS (PARTITION BY site_id ORDER BY datetime))"""


@query(
    "acf",
    with_views("SELECT site_id, " + ", ".join(f"{R(ACF_SQL.format(k=k), 6)} AS acf{k}" for k in (1, 2, 12)) + f" FROM {LAGGED} GROUP BY site_id", "fixed_complete"),
)
def _(v):
    full = cal.complete_fixed_months(v.monthly, ["site_id"], *CALENDAR)
    return rounds(series.acf(full, ["site_id"], "observation", [1, 2, 12]), "acf1", "acf2", "acf12", digits=6)


STATS = ("mean", "median", "sd", "IQR")


@query(
    "series_stats",
    with_views(
        f"""SELECT site_id, {R('avg(observation)')} AS mean, {R('median(observation)')} AS median, {R('stddev_samp(observation)')} AS sd,
              {R('quantile_cont(observation, 0.75) - quantile_cont(observation, 0.25)')} AS "IQR",
              {R('avg(observation) / nullif(stddev_samp(observation), 0)', 6)} AS stability,
              {R(ACF_SQL.format(k=1), 6)} AS acf1, {R(ACF_SQL.format(k=12), 6)} AS acf12, count(*) AS n FROM {LAGGED} GROUP BY site_id""",
        "fixed_complete",
    ),
)
def _(v):
    full = cal.complete_fixed_months(v.monthly, ["site_id"], *CALENDAR)
    stats = series.series_stats(full, ["site_id"])
    return rounds(rounds(stats, *STATS), "stability", "acf1", "acf12", digits=6)


@query(
    "equal_breaks",
    with_views(f"SELECT i::INTEGER AS i, {R('CASE WHEN i = 10 THEN hi ELSE lo + (hi - lo) / 10 * i END')} AS b FROM (SELECT min(observation) AS lo, max(observation) AS hi FROM fixed_complete), (SELECT unnest(range(0, 11)) AS i)", "fixed_complete"),
)
def _(v):
    full = cal.complete_fixed_months(v.monthly, ["site_id"], *CALENDAR)
    return series.equal_breaks(full, "observation").select(F.posexplode("breaks").alias("i", "b")).withColumn("b", rounded("b"))


@query(
    "log_breaks",
    with_views(f"SELECT i::INTEGER AS i, {R('exp(ln(top) * i / 10)')} AS b FROM (SELECT max(observation) - min(observation) + 1 AS top FROM fixed_complete), (SELECT unnest(range(0, 11)) AS i)", "fixed_complete"),
)
def _(v):
    full = cal.complete_fixed_months(v.monthly, ["site_id"], *CALENDAR)
    return series.log_breaks(full, "observation").select(F.posexplode("breaks").alias("i", "b")).withColumn("b", rounded("b"))


CLASS_SQL = """
    SELECT site_id, year(datetime)::INTEGER AS year, month(datetime)::INTEGER AS month, observation AS Q,
           CASE WHEN observation >= lo AND observation <= hi THEN
             least(len(list_filter(range(0, 11), lambda i: (CASE WHEN i = 10 THEN hi ELSE lo + (hi - lo) / 10 * i END) <= observation)), 10)
           END::INTEGER AS class
    FROM (SELECT * FROM fixed_complete WHERE observation IS NOT NULL AND year(datetime) <= 2000),
         (SELECT min(observation) AS lo, max(observation) AS hi FROM fixed_complete WHERE year(datetime) <= 2000)
"""


def _calendar_rows(v):
    full = cal.complete_fixed_months(v.monthly, ["site_id"], *CALENDAR)
    return full.where(F.year("datetime") <= CALENDAR[1])


@query("monthly_flow_classes", with_views(f"SELECT site_id, year, month, {R('Q')} AS \"Q\", class FROM ({CLASS_SQL})", "fixed_complete"))
def _(v):
    rows = _calendar_rows(v)
    return rounds(series.monthly_flow_classes(rows, ["site_id"], series.equal_breaks(rows, "observation")), "Q")


@query(
    "colwell",
    with_views(
        f"""SELECT site_id, P, C, M, C / nullif(P, 0) AS "CP", M / nullif(P, 0) AS "MP" FROM (
              WITH counts AS (SELECT site_id, month, class, count(*)::DOUBLE AS n FROM ({CLASS_SQL}) GROUP BY ALL),
                   total AS (SELECT site_id, sum(n) AS z FROM counts GROUP BY 1),
                   h AS (SELECT site_id, -sum(n / z * log2(n / z)) AS hxy FROM counts JOIN total USING (site_id) GROUP BY 1),
                   hx AS (SELECT site_id, -sum(n / z * log2(n / z)) AS hx FROM
                     (SELECT site_id, month, sum(n) AS n FROM counts GROUP BY 1, 2) JOIN total USING (site_id) GROUP BY 1),
                   hy AS (SELECT site_id, -sum(n / z * log2(n / z)) AS hy FROM
                     (SELECT site_id, class, sum(n) AS n FROM counts GROUP BY 1, 2) JOIN total USING (site_id) GROUP BY 1)
              SELECT site_id, round_even(1 - (hxy - hx) / log2(11), 2) AS P, round_even(1 - hy / log2(11), 2) AS C,
                     round_even((hx + hy - hxy) / log2(11), 2) AS M
              FROM h JOIN hx USING (site_id) JOIN hy USING (site_id))""",
        "fixed_complete",
    ),
)
def _(v):
    rows = _calendar_rows(v)
    return series.colwell(rows, ["site_id"], series.equal_breaks(rows, "observation"))
