"""Scoring and skill metrics over the fixture forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F


from fluxloom.functions.labels import MODEL_NAMES
from fluxloom.operators import scoring, skill
from workload.registry import query, rounded, sql_rounded as R
from workload.series_queries import rounds
from workload.views import ISSUE
from workload.views_sql import with_views

MODELS_AFTER_FIRST = list(MODEL_NAMES.values())[1:]
#: Rounds of sweeping; each shrinks what is left of the two effects by their overlap.
SWEEPS = 60
KEYS = "horizon, site_id, model_id, Temp, year, CO2Treat, Veg"
SEPARATE = "FROM formatted WHERE horizon = 6 AND CO2Treat = 'Amb' AND Type = 'Separate'"
OBS, FC = "observation", "mean"


def metric_sql(column: str, name: str, digits: int = 4) -> str:
    return with_views(f"SELECT {KEYS}, {R(column, digits)} AS {name}, count(*) AS n {SEPARATE} GROUP BY ALL", "formatted")


def metric(name: str, column: str, sql: str, digits: int = 4):
    @query(name, metric_sql(sql, column, digits))
    def _(v):
        return rounds(skill.skill(v.formatted, {column: skill.metric_columns()[column]}), column, digits=digits)


# ---- scoring ----------------------------------------------------------------------------------

SCORE_COLUMNS = ("observation", "mean", "sd", "crps", "logs")


@query(
    "score_all",
    with_views(
        f"SELECT project_id, model_id, datetime, reference_datetime, site_id, horizon, {R('observation')} AS observation, {R('mean')} AS mean, {R('sd')} AS sd, {R('crps', 2)} AS crps, {R('logs', 6)} AS logs FROM scores",
        "scores",
    ),
)
def _(v):
    rows = v.scores.select("project_id", "model_id", "datetime", "reference_datetime", "site_id", "horizon", *SCORE_COLUMNS)
    return rounds(rounds(rounds(rows, "observation", "mean", "sd"), "crps", digits=2), "logs", digits=6)


@query(
    "to_distribution",
    with_views(f"SELECT model_id, datetime, reference_datetime, site_id, family, variable, {R('mu')} AS mu, {R('sigma')} AS sigma FROM fixture_dist", "fixture_dist"),
)
def _(v):
    return rounds(scoring.to_distribution(v.forecasts).drop("project_id", "duration"), "mu", "sigma")


@query("crps_normal", with_views(f"SELECT model_id, site_id, datetime, reference_datetime, {R('crps', 2)} AS crps FROM scores", "scores"))
def _(v):
    """From the one-row layout, without the interchange rows."""
    rows = scoring.score_distributions(v.fixture_dist, v.all_monthly)
    return rounds(rows.select("model_id", "site_id", "datetime", "reference_datetime", "crps"), "crps", digits=2)


@query("log_score_normal", with_views(f"SELECT model_id, site_id, datetime, reference_datetime, {R('logs', 6)} AS logs FROM scores", "scores"))
def _(v):
    rows = scoring.score_distributions(v.fixture_dist, v.all_monthly)
    return rounds(rows.select("model_id", "site_id", "datetime", "reference_datetime", "logs"), "logs", digits=6)


@query(
    "forecast_summary",
    with_views(
        f"SELECT model_id, site_id, datetime, reference_datetime, {R('mu')} AS mean, {R('sigma')} AS sd, date_diff('day', reference_datetime, datetime)::INTEGER AS horizon FROM fixture_dist WHERE datetime > reference_datetime",
        "fixture_dist",
    ),
)
def _(v):
    rows = scoring.forecast_summary(v.fixture_dist)
    return rounds(rows.select("model_id", "site_id", "datetime", "reference_datetime", "mean", "sd", "horizon"), "mean", "sd")


@query(
    "crps_ensemble",
    with_views(
        f"""SELECT e.horizon, e.reference_datetime, e.datetime, {R('any_value(a) - any_value(b) / 2', 4)} AS crps, any_value(n) AS members
            FROM (SELECT horizon, reference_datetime, datetime, avg(abs(d.Temp_K - p.Temp_K)) AS a, count(*) AS n FROM driver_cells d JOIN past_drivers p USING (datetime) GROUP BY ALL) e
            JOIN (SELECT x.horizon, x.reference_datetime, x.datetime, avg(abs(x.Temp_K - y.Temp_K)) AS b FROM driver_cells x JOIN driver_cells y USING (horizon, reference_datetime, datetime) GROUP BY ALL) s
            USING (horizon, reference_datetime, datetime) GROUP BY ALL""",
        "driver_cells", "past_drivers",
    ),
)
def _(v):
    """Driver ensembles against the lead-1 mean of the month."""
    from fluxloom.operators.aggregates import past_driver_mean

    truth = past_driver_mean(v.drivers).select("datetime", F.col("Temp_K").alias("observation"))
    keys = ["horizon", "reference_datetime", "datetime"]
    members = v.driver_cells.select(*keys, F.col("Temp_K").alias("prediction")).join(truth, "datetime")
    return rounds(scoring.crps_ensemble(members, keys), "crps")


@query(
    "format_scores",
    with_views(
        f"""SELECT site_id, model_id, model_type, datetime, reference_datetime, horizon, year, Treat, Temp, Veg, CO2, CO2Treat, Transect, Type,
              {R('observation')} AS observation, {R('mean')} AS mean, {R('crps', 2)} AS crps FROM formatted""",
        "formatted",
    ),
)
def _(v):
    rows = v.formatted.select(
        "site_id", "model_id", "model_type", "datetime", "reference_datetime", "horizon", "year", "Treat", "Temp",
        "Veg", "CO2", "CO2Treat", "Transect", "Type", "observation", "mean", "crps",
    )
    return rounds(rounds(rows, "observation", "mean"), "crps", digits=2)


# ---- skill metrics ----------------------------------------------------------------------------

ERR = f"({FC} - {OBS})"
GRMSE = f"CASE WHEN min(abs({ERR})) = 0 THEN 0 ELSE exp(avg(ln(abs({ERR})))) END"
GMEAN = f"exp(avg(ln({OBS})))"

metric("rmse", "rmse", f"sqrt(avg({ERR} * {ERR}))")
metric("bias", "bias", f"avg({ERR})")
metric("mean_crps", "crps", "avg(crps)", 2)
metric("mean_ignorance", "ign", "avg(logs)", 6)
metric("mean_sd", "sd", "avg(sd)")
metric("geometric_rmse", "grmse", GRMSE)
metric("r2_one_to_one", "r2_11", f"1 - sum({ERR} * {ERR}) / nullif(var_pop({OBS}) * count({OBS}), 0)", 4)
metric("r2_regression", "r2", f"regr_r2({OBS}, {FC})", 6)
metric("rmse_over_mean", "rmse_mean", f"sqrt(avg({ERR} * {ERR})) / avg({OBS})", 6)
metric("grmse_over_gmean", "grmse_mean", f"({GRMSE}) / {GMEAN}", 6)


@query(
    "metric_table",
    with_views(
        f"""SELECT {KEYS}, CASE name WHEN 'bias' THEN 'Bias' WHEN 'crps' THEN 'CRPS' WHEN 'grmse' THEN 'Geometric~RMSE' WHEN 'r2' THEN 'R^{{2}}'
              WHEN 'rmse_mean' THEN 'RMSE/mean' WHEN 'ign' THEN 'Ignorance' WHEN 'sd' THEN 'SD' END AS name,
              CASE name WHEN 'bias' THEN 1 WHEN 'crps' THEN 2 WHEN 'grmse' THEN 3 WHEN 'r2' THEN 4 WHEN 'rmse_mean' THEN 5 WHEN 'ign' THEN 6 WHEN 'sd' THEN 7 END AS rank,
              {R('value', 2)} AS value
            FROM (SELECT {KEYS}, avg({ERR}) AS bias, avg(crps) AS crps, {GRMSE} AS grmse, regr_r2({OBS}, {FC}) AS r2,
                    sqrt(avg({ERR} * {ERR})) / avg({OBS}) AS rmse_mean, avg(logs) AS ign, avg(sd) AS sd {SEPARATE} GROUP BY ALL)
            UNPIVOT INCLUDE NULLS (value FOR name IN (crps, bias, grmse, r2, rmse_mean, ign, sd))""",
        "formatted",
    ),
)
def _(v):
    return rounds(skill.metric_table(v.formatted), "value", digits=2)


def median_rmse(name, veg):
    where = f"WHERE Veg = '{veg}'" if veg else ""

    @query(
        name,
        with_views(
            f"""SELECT horizon, Temp, year, CO2Treat, {R('rmse')} AS rmse, series,
                  {R('rmse / max(CASE WHEN Temp = 0 THEN rmse END) OVER (PARTITION BY horizon, year, CO2Treat)', 6)} AS ratio
                FROM (SELECT horizon, Temp, year, CO2Treat, median(rmse) AS rmse, count(*) AS series FROM rmse_sep {where} GROUP BY ALL)""",
            "rmse_sep",
        ),
    )
    def _(v):
        return rounds(rounds(skill.median_rmse_by_treatment(v.formatted, veg), "rmse"), "ratio", digits=6)


median_rmse("median_rmse_by_treatment", None)
median_rmse("median_rmse_by_treatment_c3", "C3")
median_rmse("median_rmse_by_treatment_c4", "C4")

CHANGE = """
    SELECT horizon, model_id, Temp, CO2Treat, Veg, Type, n, (rep - rmse) / nullif(rmse, 0) * 100 AS rmse FROM (
      SELECT *, max(CASE WHEN Type = 'Rep_comb' THEN rmse END) OVER (PARTITION BY horizon, model_id, Temp, CO2Treat, Veg) AS rep FROM (
        SELECT horizon, model_id, Temp, CO2Treat, Veg, Type, sqrt(avg((observation - mean) ** 2)) AS rmse, count(*) AS n
        FROM formatted WHERE horizon = 6 AND CO2Treat = 'Amb' GROUP BY ALL)) WHERE Type <> 'Rep_comb'
"""
VEG_LABEL = "CASE Veg WHEN 'C3' THEN 'C[3]' WHEN 'C4' THEN 'C[4]' END"


@query(
    "rmse_change_from_averaging",
    with_views(f"SELECT horizon, model_id, Temp, CO2Treat, {VEG_LABEL} AS Veg, Type, n, {R('rmse')} AS rmse FROM ({CHANGE})", "formatted"),
)
def _(v):
    return rounds(skill.rmse_change_from_averaging(v.formatted), "rmse")


@query(
    "mean_rmse_change",
    with_views(
        f"""SELECT 'by treatment' AS scope, Temp, {VEG_LABEL} AS Veg, {R('avg(rmse)')} AS rmse_change FROM ({CHANGE}) GROUP BY Temp, Veg
            UNION ALL SELECT 'overall', NULL, NULL, {R('avg(rmse)')} FROM ({CHANGE})""",
        "formatted",
    ),
)
def _(v):
    return rounds(skill.mean_rmse_change(v.formatted), "rmse_change")


@query(
    "rmse_rep_comb",
    with_views(f"SELECT {KEYS}, {R('sqrt(avg((observation - mean) ** 2))')} AS rmse, count(*) AS n FROM formatted WHERE horizon = 6 AND CO2Treat = 'Amb' AND Type = 'Rep_comb' GROUP BY ALL", "formatted"),
)
def _(v):
    return rounds(skill.rmse_rep_comb(v.formatted), "rmse")


@query(
    "box_of_rmse",
    with_views(
        "SELECT Temp, Veg, n, " + ", ".join(f"{R(c)} AS {c}" for c in ("lower", "middle", "upper", "ymin", "ymax"))
        + """ FROM (SELECT Temp, Veg, lower, middle, upper, q.n, min(rmse) AS ymin, max(rmse) AS ymax FROM rmse_sep JOIN (
              SELECT Temp, Veg, quantile_cont(rmse, 0.25) AS lower, quantile_cont(rmse, 0.5) AS middle, quantile_cont(rmse, 0.75) AS upper, count(rmse) AS n
              FROM rmse_sep GROUP BY ALL) q USING (Temp, Veg)
            WHERE rmse BETWEEN lower - (upper - lower) * 1.5 AND upper + (upper - lower) * 1.5 GROUP BY ALL)""",
        "rmse_sep",
    ),
)
def _(v):
    from fluxloom.operators.aggregates import box_summary

    return rounds(box_summary(skill.rmse_table(v.formatted), ["Temp", "Veg"], "rmse"), "lower", "middle", "upper", "ymin", "ymax")


TEMP_LABEL = "'''''+' || CASE WHEN Temp IS NULL THEN 'NA' WHEN Temp = floor(Temp) THEN CAST(floor(Temp)::INTEGER AS VARCHAR) ELSE CAST(Temp AS VARCHAR) END || '~degree~C'"
CO2_LABEL = "CASE CO2Treat WHEN 'Amb' THEN 'Ambient~CO[2]' WHEN 'Elev' THEN 'Elevated~CO[2]' END"
FOLDED = "CASE WHEN Transect > 3 THEN Transect - 3 ELSE Transect END"


@query(
    "observation_overlay",
    with_views(
        f"""SELECT site_id, datetime, {VEG_LABEL} AS Veg, {CO2_LABEL} AS CO2Treat, {TEMP_LABEL} AS Temp, {FOLDED} AS Transect,
              year(datetime)::INTEGER AS year, (DATE '2024-01-01' + (dayofyear(datetime) - 1)::INTEGER)::DATE AS yday,
              year(datetime) || site_id AS line, year(datetime) = 2000 AS forecast_year, {R('observation')} AS observation
            FROM monthly m JOIN treatments t ON m.site_id = t.Plot WHERE CO2 = 0""",
        "monthly", "treatments",
    ),
)
def _(v):
    rows = skill.observation_overlay(v.monthly, v.treatments, ISSUE.year)
    rows = rows.select("site_id", "datetime", "Veg", "CO2Treat", "Temp", "Transect", "year", "yday", "line", "forecast_year", "observation")
    return rounds(rows, "observation")


@query(
    "forecast_overlay",
    with_views(
        f"""SELECT site_id, model_id, datetime, {VEG_LABEL} AS Veg, {CO2_LABEL} AS CO2Treat, {TEMP_LABEL} AS Temp, {FOLDED} AS Transect,
              COALESCE(model_id, 'NA') || ' ' || site_id AS mod, {R('observation')} AS observation, {R('mean')} AS mean
            FROM formatted WHERE Type = 'Separate' AND horizon = 6 AND CO2 = 0""",
        "formatted",
    ),
)
def _(v):
    rows = skill.forecast_overlay(v.formatted)
    rows = rows.select("site_id", "model_id", "datetime", "Veg", "CO2Treat", "Temp", "Transect", "mod", "observation", "mean")
    return rounds(rows, "observation", "mean")


@query(
    "porewater_overlay",
    with_views(
        """SELECT SampleID, CASE Vegetation WHEN 3 THEN 'C[3]' WHEN 4 THEN 'C[4]' END AS Veg, CAST(Temperature AS VARCHAR) || '~degree*C' AS Temp,
             year(datetime)::INTEGER AS year, (DATE '2024-01-01' + (dayofyear(datetime) - 1)::INTEGER)::DATE AS yday,
             year(datetime) || Plot AS line, CH4 FROM porewater_clean""",
        "porewater_clean",
    ),
)
def _(v):
    return skill.porewater_overlay([v.porewater]).select("SampleID", "Veg", "Temp", "year", "yday", "line", "CH4")


@query(
    "plot_window",
    with_views(
        f"""SELECT site_id, datetime, {R('mu')} AS mu, {R('mu - sigma')} AS ymin, {R('mu + sigma')} AS ymax, {R('observation')} AS observation, datetime >= DATE '2000-07-01' AS ahead
            FROM (SELECT site_id, datetime, mu, sigma FROM fixture_dist WHERE reference_datetime = DATE '2000-07-01' AND model_id = 'ets') f
            FULL JOIN (SELECT site_id, datetime, observation FROM all_monthly WHERE datetime BETWEEN DATE '2000-07-01' - 180 AND DATE '2000-07-01' + 180) o
            USING (site_id, datetime)""",
        "fixture_dist", "all_monthly",
    ),
)
def _(v):
    one = v.fixture_dist.where(F.col("model_id") == "ets")
    return rounds(skill.plot_window(v.all_monthly, one, ISSUE), "mu", "ymin", "ymax", "observation")


@query(
    "fixed_effect_trend",
    with_views(
        f""", series AS (
          SELECT Veg, Temp::DOUBLE AS x, ln(rmse) AS y, CASE WHEN model_id IN ({", ".join(f"'{m}'" for m in MODELS_AFTER_FIRST)}) THEN model_id END AS model,
                 CASE WHEN Transect BETWEEN 2 AND 6 THEN Transect END AS transect FROM (
            SELECT horizon, site_id, model_id, Temp, year, CO2Treat, Veg, Transect, sqrt(avg((observation - mean) ** 2)) AS rmse
            FROM formatted WHERE horizon = 6 AND CO2Treat = 'Amb' AND Type = 'Separate' GROUP BY ALL HAVING rmse > 0)),
        swept AS (
          SELECT 0 AS k, *, x * x AS x0 FROM series
          UNION ALL
          SELECT k + 1, Veg, x - avg(x) OVER t, y - avg(y) OVER t, model, transect, x0 FROM (
            SELECT k, Veg, x - avg(x) OVER m AS x, y - avg(y) OVER m AS y, model, transect, x0 FROM swept WHERE k < {SWEEPS} WINDOW m AS (PARTITION BY Veg, model))
          WINDOW t AS (PARTITION BY Veg, transect)),
        sums AS (
          SELECT Veg, count(*)::DOUBLE AS n, sum(x * x) AS xx, sum(x0) AS x0, sum(x * y) AS xy, sum(y * y) AS yy,
                 count(DISTINCT coalesce(model, '')) + count(DISTINCT coalesce(transect, 0)) AS rank FROM swept WHERE k = {SWEEPS} GROUP BY Veg),
        fit AS (SELECT Veg, n, CASE WHEN xx > 1e-9 * x0 THEN xy / xx END AS slope,
                       CASE WHEN xx > 1e-9 * x0 AND n > rank THEN sqrt((yy - xy * xy / xx) / (n - rank) / xx) END AS se FROM sums)
        SELECT Veg, n, {R('slope', 6)} AS slope, {R('se', 6)} AS se, {R('slope / se', 6)} AS t FROM fit""",
        "formatted", recursive=True,
    ),
)
def _(v):
    """Slope, standard error and t; the SQL sweeps models and transects out in turn until only warming is left."""
    from fluxloom.plans.trend import fixed_effect_trend

    return rounds(fixed_effect_trend(v.formatted).select("Veg", "n", "slope", "se", "t"), "slope", "se", "t", digits=6)
