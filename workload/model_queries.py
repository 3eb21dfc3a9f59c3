"""Forecast models and runs."""

from __future__ import annotations

from pyspark.sql import functions as F


from fluxloom.operators import linalg, scoring, skill

from fluxloom.plans import additive, arima, common, driver_models, edm, ets, runs, trees
from fluxloom.plans.climatology import fc_climatology
from fluxloom.plans.library import MODELS
from fluxloom.session import staged
from fluxloom.sources import tables
from workload.ingest_queries import scratch
from workload.registry import query, rounded, sql_rounded as R
from workload.series_queries import rounds
from workload.views import BACKFILL, ISSUE, SCORE_YEAR
from workload.views_sql import SUPPLIER_MONTHLY, with_views

OUT = ("model_id", "site_id", "datetime", "reference_datetime", "mu", "sigma")


def forecast_rows(df, digits=4):
    return rounds(df.select(*OUT), "mu", "sigma", digits=digits)


def climatology_sql(source: str, issues: str) -> str:
    """Climatology by building every training set: an inner query yielding site, issue, date, mu, sigma."""
    return f"""
    WITH iss AS ({issues}),
    tr AS (SELECT site_id, issue, datetime, observation FROM {source} JOIN iss ON datetime <= issue),
    st AS (SELECT site_id, issue, month(datetime) AS m, avg(observation) AS mean, stddev_samp(observation) AS sd FROM tr GROUP BY ALL),
    ends AS (SELECT site_id, issue, max(datetime) AS last FROM tr GROUP BY ALL HAVING count(observation) >= 5),
    ahead AS (SELECT site_id, issue, unnest(generate_series(last + INTERVAL 1 MONTH, issue + INTERVAL 6 MONTH, INTERVAL 1 MONTH))::DATE AS datetime FROM ends),
    cells AS (SELECT a.*, s.mean AS y, s.sd, row_number() OVER (PARTITION BY a.site_id, a.issue ORDER BY a.datetime) AS k
              FROM ahead a LEFT JOIN st s ON a.site_id = s.site_id AND a.issue = s.issue AND month(a.datetime) = s.m),
    near AS (SELECT *, max(CASE WHEN y IS NOT NULL THEN k END) OVER b AS ka, min(CASE WHEN y IS NOT NULL THEN k END) OVER f AS kb,
               last_value(y IGNORE NULLS) OVER b AS ya, first_value(y IGNORE NULLS) OVER f AS yb,
               median(sd) OVER (PARTITION BY site_id, issue) AS sigma
             FROM cells WINDOW b AS (PARTITION BY site_id, issue ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                               f AS (PARTITION BY site_id, issue ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT site_id, issue, datetime, sigma, CASE WHEN y IS NOT NULL THEN y WHEN ya IS NULL THEN yb WHEN yb IS NULL THEN ya
             ELSE ya + (yb - ya) * (CAST(k - ka AS DOUBLE) / (kb - ka)) END AS mu
    FROM near WHERE sigma IS NOT NULL AND (ya IS NOT NULL OR yb IS NOT NULL) AND datetime >= issue
    """


ONE_ISSUE = "SELECT DATE '2000-07-01' AS issue"
ALL_ISSUES = "SELECT unnest(generate_series(DATE '1999-01-01', DATE '2001-01-01', INTERVAL 1 MONTH))::DATE AS issue"


def climatology_query(source: str, issues: str, **others) -> str:
    return with_views(
        f"SELECT 'climatology' AS model_id, site_id, datetime, issue AS reference_datetime, {R('mu')} AS mu, {R('sigma')} AS sigma FROM ({climatology_sql(source, issues)})",
        source, **others,
    )


# ---- shared contract --------------------------------------------------------------------------


@query(
    "training_window",
    with_views(f"SELECT issue, site_id, datetime, {R('observation')} AS observation FROM monthly JOIN ({ALL_ISSUES}) ON datetime < issue", "monthly"),
)
def _(v):
    rows = common.training_window(v.monthly, v.backfill_issues)
    return rounds(rows.select("issue", "site_id", "datetime", "observation"), "observation")


@query("fan_out_keys", with_views("SELECT project_id, site_id, variable, count(observation) AS months FROM all_monthly GROUP BY ALL", "all_monthly"))
def _(v):
    return common.fan_out_keys(v.all_monthly)


@query("target_variables", with_views("SELECT site_id, variable, count(*) AS n FROM monthly WHERE variable = 'CH4_slope_umol_m2_d' GROUP BY ALL", "monthly"))
def _(v):
    listed = v.spark.sql("SELECT 'Methane flux' AS name, 'CH4_slope_umol_m2_d' AS target")
    return common.target_variables(v.monthly, listed).groupBy("site_id", "variable").agg(F.count("*").alias("n"))


@query(
    "finish_forecast",
    with_views("SELECT 'm' AS model_id, site_id, datetime, DATE '2000-07-01' AS reference_datetime, 'normal' AS family, 'P1M' AS duration, " + R("observation") + " AS mu FROM monthly WHERE datetime >= DATE '2000-07-01'", "monthly"),
)
def _(v):
    rows = v.monthly.select(*common.SERIES, F.lit(ISSUE).alias("issue"), "datetime", F.col("observation").alias("mu"), F.lit(1.0).alias("sigma"))
    done = common.finish_forecast(rows, "m")
    return rounds(done.select("model_id", "site_id", "datetime", "reference_datetime", "family", "duration", "mu"), "mu")


@query("write_forecast", climatology_query("monthly", ALL_ISSUES))
def _(v):
    """Stored twice; the second write replaces the first, so nothing is doubled."""
    path = scratch(v, "store")
    forecast = fc_climatology(v.monthly, None, v.backfill_issues).withColumn("variant", F.lit("separate"))
    tables.write_forecast(forecast, path)
    late = forecast.where(F.col("reference_datetime") >= F.lit(ISSUE))
    tables.write_forecast(late, path)
    return forecast_rows(v.spark.read.parquet(path))


# ---- models -----------------------------------------------------------------------------------


@query("fc_climatology", climatology_query("monthly", ONE_ISSUE))
def _(v):
    return forecast_rows(fc_climatology(v.monthly, None, v.issues))


@query("fc_climatology_backfill", climatology_query("monthly", ALL_ISSUES))
def _(v):
    return forecast_rows(fc_climatology(v.monthly, None, v.backfill_issues))


@query("replicate_mode", climatology_query("rep_monthly", ALL_ISSUES))
def _(v):
    forecast = runs.issue_forecast("climatology", v.daily, None, v.backfill_issues, runs.REPLICATES)
    return forecast_rows(forecast)


@query("issue_forecast", climatology_query("monthly", ONE_ISSUE))
def _(v):
    return forecast_rows(runs.issue_forecast("climatology", v.daily, None, v.issues))


@query("backfill", climatology_query("monthly", ALL_ISSUES))
def _(v):
    """A store missing most dates is completed; a second backfill then writes nothing."""
    path = scratch(v, "backfill")
    some = v.backfill_issues.where(F.month("issue") == 5)
    tables.write_forecast(runs.issue_forecast("climatology", v.daily, None, some), path)
    errors = runs.backfill(v.spark, "climatology", v.daily, None, path, *BACKFILL)
    assert errors.isEmpty()
    return forecast_rows(v.spark.read.parquet(path))


ETS_GRID = ets.parameter_grid()
ETS_BODY = (
    """, points AS (SELECT * FROM (VALUES """
    + ", ".join(f"({i}, {a}e0, {b}e0, {phi}e0, {g}e0, {k})" for i, (a, b, phi, g, k) in enumerate(ETS_GRID))
    + f""") AS t(pid, a, b, phi, g, np)),
    sizes AS (SELECT site_id, max(k) AS n, max(datetime) AS last,
        avg(CASE WHEN k <= 12 THEN y END) AS m1, CASE WHEN max(k) >= 24 THEN avg(CASE WHEN k BETWEEN 13 AND 24 THEN y END) END AS m2,
        list(y ORDER BY k) AS ys FROM train_filled GROUP BY site_id),
    init AS (SELECT s.*, p.*, n >= 24 AS long, CASE WHEN n >= 24 THEN (m2 - m1) / 12 ELSE 0e0 END AS slope FROM sizes s, points p),
    fold AS (
      SELECT site_id, pid, n, a, b, phi, g, np, last, 0::BIGINT AS t, m1 - (CASE WHEN phi > 0 THEN slope ELSE 0 END) * 6.5 AS l,
             (CASE WHEN phi > 0 THEN slope ELSE 0 END)::DOUBLE AS tr,
             CASE WHEN g > 0 THEN list_transform(range(1, 13), lambda i: (ys[i] - m1 + ys[i + 12] - m2) / 2)
                  ELSE list_transform(range(1, 13), lambda i: 0e0) END AS s, 0e0 AS sse, ys
      FROM init WHERE n - np - 2 > 0 AND (g = 0 OR long)
      UNION ALL
      SELECT site_id, pid, n, a, b, phi, g, np, last, t + 1, l + phi * tr + a * e, phi * tr + b * e, s[2:12] || [s[1] + g * e], sse + e * e, ys
      FROM (SELECT *, ys[t + 1] - (l + phi * tr) - s[1] AS e FROM fold WHERE t < n)),
    rated AS (SELECT *, n * ln(sse) + 2 * (np + 1) + 2.0e0 * (np + 1) * (np + 2) / (n - np - 2) AS aicc FROM fold WHERE t = n),
    best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY aicc, pid) = 1),
    steps AS (SELECT best.*, unnest(range(1, (date_diff('month', last, DATE '2000-07-01') + 7)))::BIGINT AS j FROM best),
    damp AS (SELECT *, CASE WHEN phi > 0 THEN phi * (1 - phi ** j) / (1 - phi) ELSE 0e0 END AS dj FROM steps),
    resp AS (SELECT *, a + b * dj + (CASE WHEN j % 12 = 0 THEN g ELSE 0e0 END) AS c FROM damp),
    cum AS (SELECT *, 1 + COALESCE(sum(c * c) OVER (PARTITION BY site_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spread FROM resp)
    SELECT 'ets' AS model_id, site_id, (last + to_months(j::INTEGER))::DATE AS datetime, DATE '2000-07-01' AS reference_datetime,
           {R('l + dj * tr + s[((j - 1) % 12 + 1)]')} AS mu, {R('0.994457883209753e0 * sqrt(sse / (n - np) * spread)')} AS sigma
    FROM cum WHERE (last + to_months(j::INTEGER))::DATE >= DATE '2000-07-01'"""
)
ETS_SQL = with_views(ETS_BODY, "train_filled", recursive=True)


@query("fc_ets", ETS_SQL)
def _(v):
    return forecast_rows(MODELS["ets"](v.monthly, None, v.issues))


EDM_BODY = (
    """, sized AS (SELECT *, max(k) OVER (PARTITION BY site_id) AS n FROM train_filled),
    libs AS (SELECT *, round_even(n * 0.8e0, 0)::BIGINT AS lib FROM sized),
    dims AS (SELECT unnest(range(1, 13)) AS E),
    pairs AS (SELECT p.site_id, d.E, p.k AS t, s.k AS s,
        sqrt(list_sum(list_transform(range(0, d.E), lambda i: (yp.ys[p.k - i] - yp.ys[s.k - i]) ** 2))) AS dist, yp.ys[s.k + 6] AS target, yp.ys[p.k + 6] AS obs
      FROM libs p JOIN libs s ON p.site_id = s.site_id
      JOIN (SELECT site_id, list(y ORDER BY k) AS ys FROM train_filled GROUP BY 1) yp ON yp.site_id = p.site_id, dims d
      WHERE p.k > p.lib AND p.k + 6 <= p.n AND p.k >= d.E AND s.k >= d.E AND s.k + 6 <= s.lib),
    near AS (SELECT *, row_number() OVER w AS r, min(dist) OVER (PARTITION BY site_id, E, t) AS d1 FROM pairs
             WINDOW w AS (PARTITION BY site_id, E, t ORDER BY dist, s)),
    preds AS (SELECT site_id, E, t, any_value(obs) AS obs, sum(w * target) / sum(w) AS pred FROM (
        SELECT *, CASE WHEN d1 > 0 THEN greatest(exp(-dist / d1), 1e-6) WHEN dist > 0 THEN 1e-6 ELSE 1e0 END AS w FROM near WHERE r <= E + 1) GROUP BY ALL),
    skill AS (SELECT site_id, E, corr(pred, obs) AS rho FROM preds GROUP BY ALL)
    """
    + f"""SELECT site_id, DATE '2000-07-01' AS issue, E::INTEGER AS "E", {R('rho', 6)} AS rho FROM skill WHERE rho IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY rho DESC, E) = 1"""
)
EDM_SQL = with_views(EDM_BODY, "train_filled")


@query("edm_select_dimension", EDM_SQL)
def _(v):
    chosen = edm.edm_select_dimension(v.monthly, v.issues)
    return rounds(chosen.select("site_id", "issue", "E", "rho"), "rho", digits=6)


# ---- series that grow with the data: one per supplier -------------------------------------------


@query("fc_ets_suppliers", with_views(ETS_BODY, "train_filled", recursive=True, monthly=SUPPLIER_MONTHLY))
def _(v):
    return forecast_rows(MODELS["ets"](v.supplier_monthly, None, v.issues))


@query("edm_select_dimension_suppliers", with_views(EDM_BODY, "train_filled", monthly=SUPPLIER_MONTHLY))
def _(v):
    chosen = edm.edm_select_dimension(v.supplier_monthly, v.issues)
    return rounds(chosen.select("site_id", "issue", "E", "rho"), "rho", digits=6)


@query("fc_climatology_suppliers", climatology_query("monthly", ALL_ISSUES, monthly=SUPPLIER_MONTHLY))
def _(v):
    return forecast_rows(fc_climatology(v.supplier_monthly, None, v.backfill_issues))


GAP = 1e-6


def balanced(df, x, y, coef, keys, ridge=0.0):
    """Largest normal-equation gap of emitted coefficients over the raw rows, per key: sum of x times residual less the penalty."""
    z = F.concat(F.array(F.lit(1.0)), x)
    rows = df.select(*keys, z.alias("_z"), coef.alias("_c"), (y - linalg.dot(coef, z)).alias("_e"), y.alias("_y"))
    cells = rows.select(*keys, "_e", "_y", "_c", F.posexplode("_z").alias("_j", "_v"))
    sums = cells.groupBy(*keys, "_j").agg(
        (F.sum(F.col("_v") * F.col("_e")) - F.when(F.col("_j") > 0, ridge * F.first(F.get("_c", F.col("_j")))).otherwise(0.0)).alias("left"),
        F.sqrt(F.sum(F.col("_v") * F.col("_v")) * F.sum(F.col("_y") * F.col("_y"))).alias("size"),
    )
    return sums.groupBy(*keys).agg((F.max(F.abs(F.col("left")) / F.greatest("size", F.lit(1e-300))) < GAP).alias("normal_equations"))


@query("smap_fit", with_views("SELECT site_id, TRUE AS normal_equations, TRUE AS dimension_in_range FROM train_ok GROUP BY site_id", "train_ok"))
def _(v):
    """The map's residuals are recomputed from the series and balance against every lag."""
    fit = edm.smap_fit(v.monthly, v.issues)
    rows = fit.select("site_id", "E", "y", "coef", F.explode(F.sequence("E", F.col("size") - 1)).alias("t"))
    lags = F.reverse(F.slice("y", F.col("t") - F.col("E") + 1, F.col("E")))
    checked = balanced(rows, lags, F.get("y", F.col("t")), F.col("coef"), ["site_id", "E"])
    return checked.select("site_id", "normal_equations", F.col("E").between(1, 12).alias("dimension_in_range"))


def shape_sql(model: str, source: str, **others) -> str:
    """Months from the issue date to six after it, per site, with finite positive spread."""
    return with_views(
        f"""SELECT '{model}' AS model_id, site_id, d::DATE AS datetime, DATE '2000-07-01' AS reference_datetime, TRUE AS usable FROM
              (SELECT DISTINCT site_id FROM {source}), (SELECT unnest(generate_series(DATE '2000-07-01', DATE '2001-01-01', INTERVAL 1 MONTH)) AS d)""",
        source, **others,
    )


def shaped(df):
    usable = F.col("mu").isNotNull() & ~F.isnan("mu") & (F.abs("mu") < 1e7) & (F.col("sigma") > 0) & (F.col("sigma") < 1e7)
    return df.select("model_id", "site_id", "datetime", "reference_datetime", usable.alias("usable"))


@query("fc_smap", shape_sql("rEDM", "train_ok"))
def _(v):
    return shaped(MODELS["rEDM"](v.monthly, None, v.issues))


@query("fc_arima", shape_sql("auto.arima", "train_ok"))
def _(v):
    return shaped(MODELS["auto.arima"](v.monthly, None, v.issues))


@query("fc_arima_suppliers", shape_sql("auto.arima", "train_ok", monthly=SUPPLIER_MONTHLY))
def _(v):
    return shaped(MODELS["auto.arima"](v.supplier_monthly, None, v.issues))


@query("fc_additive_suppliers", shape_sql("prophet", "train_ok", monthly=SUPPLIER_MONTHLY))
def _(v):
    return shaped(MODELS["prophet"](v.supplier_monthly, None, v.issues))


@query("fc_smap_suppliers", shape_sql("rEDM", "train_ok", monthly=SUPPLIER_MONTHLY))
def _(v):
    return shaped(MODELS["rEDM"](v.supplier_monthly, None, v.issues))


def backfill_shape(model: str, source: str = "monthly") -> str:
    """Months from each issue date to six after it, for every site with five values before the date."""
    return with_views(
        f"""SELECT '{model}' AS model_id, site_id, unnest(generate_series(issue, issue + INTERVAL 6 MONTH, INTERVAL 1 MONTH))::DATE AS datetime,
              issue AS reference_datetime, TRUE AS usable FROM (
                SELECT site_id, issue FROM {source} JOIN ({ALL_ISSUES}) ON datetime < issue GROUP BY ALL HAVING count(observation) >= 5)""",
        source,
    )


def backfill_model(model: str):
    @query(f"backfill_{model}", backfill_shape(model))
    def _(v):
        """All issue dates of one model, forecast and stored in one run."""
        path = scratch(v, f"backfill-{model}")
        errors = runs.backfill(v.spark, model, v.daily, None, path, *BACKFILL)
        assert errors.isEmpty()
        return shaped(v.spark.read.parquet(path))


for _model in ("ets", "auto.arima", "prophet", "rEDM"):
    backfill_model(_model)


@query("replicate_mode_ets", backfill_shape("ets", "rep_monthly"))
def _(v):
    return shaped(runs.issue_forecast("ets", v.daily, None, v.backfill_issues, runs.REPLICATES))


REP_TRAIN = {"train": (("rep_monthly",), "SELECT site_id, datetime, observation FROM rep_monthly WHERE datetime < DATE '2000-07-01'")}


def replicate_model(model: str, sql: str):
    @query(f"replicate_mode_{model}", sql)
    def _(v):
        """The same model on replicate-group series."""
        return shaped(runs.issue_forecast(model, v.daily, v.drivers, v.issues, runs.REPLICATES))


for _model in ("auto.arima", "prophet", "rEDM"):
    replicate_model(_model, shape_sql(_model, "train_ok", **REP_TRAIN))


ARIMA_ROWS = """(SELECT site_id, count(*) AS n FROM (
    SELECT *, list_aggregate([lag(w, 1) OVER s, lag(w, 2) OVER s, lag(w, 3) OVER s, lag(w, 4) OVER s, lag(w, 5) OVER s, lag(w, 12) OVER s,
                              lag(e, 1) OVER s, lag(e, 2) OVER s, lag(e, 12) OVER s], 'count') AS present FROM (
      SELECT *, CASE WHEN list_aggregate([w, lag(w, 1) OVER s, lag(w, 2) OVER s, lag(w, 3) OVER s, lag(w, 4) OVER s, lag(w, 5) OVER s,
                                          lag(w, 6) OVER s], 'count') = 7 THEN 1 END AS e FROM (
        SELECT site_id, datetime, observation - lag(observation, 12) OVER s AS w FROM train_complete
        WINDOW s AS (PARTITION BY site_id ORDER BY datetime)) WINDOW s AS (PARTITION BY site_id ORDER BY datetime))
    WINDOW s AS (PARTITION BY site_id ORDER BY datetime)) WHERE w IS NOT NULL AND present = 9 GROUP BY site_id HAVING count(*) >= 4)"""


@query(
    "arima_orders",
    with_views(f"SELECT site_id, n::DOUBLE AS n, TRUE AS aicc_recomputed, TRUE AS within_limits FROM {ARIMA_ROWS}", "train_complete"),
)
def _(v):
    """The reported criterion follows from the reported fit, and the order from the limits."""
    fits = arima.arima_orders(arima.arima_rows(v.monthly, v.issues))
    k = F.col("p") + F.col("q") + F.col("sp") + F.col("sq") + 2
    n = F.col("n")
    aicc = n * F.log(F.col("rss") / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
    limits = F.col("p").between(0, 5) & F.col("q").between(0, 2) & F.col("sp").between(0, 1) & F.col("sq").between(0, 1)
    return fits.where(F.col("p").isNotNull()).select(
        "site_id", "n", (F.abs(aicc - F.col("aicc")) < 1e-6).alias("aicc_recomputed"), limits.alias("within_limits")
    )


@query("arima_fit", with_views(f"SELECT site_id, n::DOUBLE AS n, TRUE AS normal_equations FROM {ARIMA_ROWS}", "train_complete"))
def _(v):
    """Residuals of the emitted coefficients, recomputed from the lagged rows, balance against every term of the order."""
    rows = staged(arima.arima_rows(v.monthly, v.issues), "arima")
    fits = arima.arima_orders(rows).where(F.col("p").isNotNull())
    limits = [*[("p", i) for i in range(1, 6)], ("sp", 1), ("q", 1), ("q", 2), ("sq", 1)]
    terms = F.array(*[F.when(F.col(c) >= k, F.col(name)).otherwise(0.0) for name, (c, k) in zip(arima.LAGS, limits)])
    samples = arima.arima_samples(rows).join(fits.select(*common.FITS, "n", "coef", "p", "q", "sp", "sq"), list(common.FITS))
    return balanced(samples, terms, F.col("w"), F.col("coef"), ["site_id", "n"])


@query(
    "arima_coefficients",
    with_views(
        f"""SELECT site_id, name, Type, 1::BIGINT AS n FROM {ARIMA_ROWS} CROSS JOIN (
              SELECT unnest(['drift', 'ar1', 'ar2', 'ar3', 'ar4', 'ar5', 'ma1', 'ma2', 'ar1', 'ma1']) AS name,
                     unnest(list_concat(list_transform(range(0, 8), lambda i: 'Non-seasonal'), ['Seasonal', 'Seasonal'])) AS Type)""",
        "train_complete",
    ),
)
def _(v):
    rows = arima.arima_coefficients(v.monthly, v.issues)
    return rows.groupBy("site_id", "name", "Type").agg(F.count("*").alias("n"))


@query("additive_fit", with_views("SELECT site_id, count(*)::DOUBLE AS n, TRUE AS normal_equations, 47::BIGINT AS terms FROM train_ok GROUP BY site_id", "train_ok"))
def _(v):
    """The residuals are recomputed from the rows with the design as columns, not as the fit builds it."""
    fit = additive.additive_fit(v.monthly, v.issues)
    rows = additive.additive_samples(v.monthly, v.issues).join(fit.select(*common.FITS, "n", "coef"), list(common.FITS))
    checked = balanced(rows, F.col("x"), F.col("observation"), F.col("coef"), ["site_id", "n"], ridge=1.0)
    return checked.select("site_id", "n", "normal_equations", F.lit(47).cast("long").alias("terms"))


@query("fc_additive", shape_sql("prophet", "train_ok"))
def _(v):
    return shaped(MODELS["prophet"](v.monthly, None, v.issues))


# ---- least squares ----------------------------------------------------------------------------


@query(
    "gram_fit",
    f"""SELECT l_returnflag, count(*)::DOUBLE AS n, {R('regr_slope(l_extendedprice, l_quantity)', 3)} AS slope,
          {R('regr_intercept(l_extendedprice, l_quantity)', 3)} AS intercept, TRUE AS normal_equations FROM lineitem GROUP BY l_returnflag""",
)
def _(v):
    fit = linalg.gram_fit(v.table("lineitem"), ["l_returnflag"], [F.col("l_quantity")], F.col("l_extendedprice"))
    return fit.select(
        "l_returnflag", "n", rounded(F.col("coef")[1], 3).alias("slope"), rounded(F.col("coef")[0], 3).alias("intercept"),
        (F.col("gap") < GAP).alias("normal_equations"),
    )


@query(
    "gram_entries",
    with_views(
        """SELECT site_id, pos::INTEGER AS pos, """ + R("v", 2) + """ AS value FROM (SELECT site_id, unnest(range(0, 10)) AS pos,
             unnest([count(*)::DOUBLE, sum(Temp_K), sum(WindSpeed_ms), sum(observation), sum(Temp_K * Temp_K), sum(Temp_K * WindSpeed_ms),
                     sum(Temp_K * observation), sum(WindSpeed_ms * WindSpeed_ms), sum(WindSpeed_ms * observation), NULL]) AS v
           FROM driver_rows GROUP BY site_id) WHERE pos < 9""",
        "driver_rows",
    ),
)
def _(v):
    """Running Gram sums looked up at the issue date equal sums over its training rows."""
    rows = driver_models.complete_rows(v.monthly, v.drivers)
    g = linalg.gram(rows, common.SERIES, [F.col("Temp_K"), F.col("WindSpeed_ms")], F.col("observation"), common.issue_array(v.issues))
    cells = g.select("site_id", F.posexplode("gram").alias("pos", "value")).where(F.col("pos") < 9)
    return rounds(cells, "value", digits=2)


@query(
    "standardize",
    with_views(
        f"""SELECT site_id, datetime, {R('(Temp_K - avg(Temp_K) OVER w) / stddev_samp(Temp_K) OVER w', 6)} AS Temp_K,
              {R('(Pressure_Pa - avg(Pressure_Pa) OVER w) / stddev_samp(Pressure_Pa) OVER w', 6)} AS Pressure_Pa
            FROM driver_train WINDOW w AS (PARTITION BY site_id)""",
        "driver_train",
    ),
)
def _(v):
    rows = driver_models.driver_training(v.monthly, v.drivers, v.issues)
    scaled = driver_models.standardize(rows, common.FITS, ["Temp_K", "Pressure_Pa"])
    return rounds(scaled.select("site_id", "datetime", "Temp_K", "Pressure_Pa"), "Temp_K", "Pressure_Pa", digits=6)


@query("cv_folds", "SELECT r AS repeat, count(*) AS n, TRUE AS covered FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS r) GROUP BY r")
def _(v):
    """Fold sizes of each repeat add up to all rows, and every fold is used."""
    folds = driver_models.cv_folds(v.table("orders").select("o_orderkey"), ["o_orderkey"], 5, 5)
    return folds.groupBy("repeat").agg(F.count("*").alias("n"), (F.count_distinct("fold") == 5).alias("covered"))


@query(
    "fit_residual_sd",
    with_views(f"SELECT site_id, {R('stddev_samp(Temp_K - observation)')} AS residual_sd FROM driver_train GROUP BY site_id", "driver_train"),
)
def _(v):
    rows = driver_models.driver_training(v.monthly, v.drivers, v.issues).withColumn("prediction", F.col("Temp_K"))
    return rounds(driver_models.fit_residual_sd(rows), "residual_sd")


MEMBER_MODEL = """(SELECT site_id, regr_slope(observation, Temp_K) AS b, regr_intercept(observation, Temp_K) AS a,
    sqrt((regr_syy(observation, Temp_K) - regr_sxy(observation, Temp_K) ** 2 / regr_sxx(observation, Temp_K)) / (count(*) - 1)) AS rsd
    FROM driver_train GROUP BY site_id)"""


def _simple_fit(v):
    rows = driver_models.driver_training(v.monthly, v.drivers, v.issues)
    return linalg.gram_fit(rows, common.FITS, [F.col("Temp_K")], F.col("observation"))


def _members(v):
    predict = lambda x: F.col("coef")[0] + F.col("coef")[1] * x[0]
    return driver_models.apply_to_members(_simple_fit(v), driver_models.member_arrays(v.drivers, v.issues), predict)


@query(
    "apply_to_members",
    with_views(f"SELECT site_id, datetime, count(*)::INTEGER AS members, {R('sum(a + b * Temp_K)', 2)} AS total FROM {MEMBER_MODEL} CROSS JOIN future GROUP BY ALL", "driver_train", "future"),
)
def _(v):
    total = F.aggregate("members", F.lit(0.0), lambda s, x: s + x)
    return _members(v).select("site_id", "datetime", F.size("members").alias("members"), rounded(total, 2).alias("total"))


@query(
    "ensemble_to_normal",
    with_views(f"SELECT site_id, datetime, {R('avg(a + b * Temp_K)', 2)} AS mu, {R('sqrt(stddev_samp(a + b * Temp_K) ** 2 + any_value(rsd) ** 2)', 2)} AS sigma FROM {MEMBER_MODEL} CROSS JOIN future GROUP BY ALL", "driver_train", "future"),
)
def _(v):
    done = driver_models.ensemble_to_normal(_members(v))
    return rounds(done.select("site_id", "datetime", "mu", "sigma"), "mu", "sigma", digits=2)


def member_sql(model: str, **others) -> str:
    return with_views(
        f"""SELECT '{model}' AS model_id, site_id, datetime, DATE '2000-07-01' AS reference_datetime, TRUE AS usable
            FROM (SELECT DISTINCT site_id FROM driver_train), (SELECT DISTINCT datetime FROM future WHERE datetime >= DATE '2000-07-01')""",
        "driver_train", "future", **others,
    )


@query("fc_elastic_net", member_sql("elasticNet"))
def _(v):
    return shaped(MODELS["elasticNet"](v.monthly, v.drivers, v.issues))


def tree_rows(better: str) -> str:
    """Per site the months and spread of a series that follows the first driver, and what the fit has to reach."""
    return with_views(
        f"""SELECT site_id, count(*) AS n, {R('stddev_samp(planted)', 2)} AS sd, TRUE AS {better} FROM (
              SELECT site_id, 100 * Temp_K + observation % 50 AS planted FROM driver_train) GROUP BY site_id""",
        "driver_train",
    )


def _against_mean(rows, better: str, part: float = 1.0):
    """Whether predictions are closer to the observations than their mean is, by ``part``; all from raw rows."""
    error = F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("observation"), 2.0)))
    sd = F.stddev_samp("observation")
    done = rows.groupBy("site_id").agg(F.count("*").alias("n"), sd.alias("sd"), (error < part * sd).alias(better))
    return rounds(done, "sd", digits=2)


def certificate_sql(flag: str, **others) -> str:
    return with_views(f"SELECT site_id, count(*)::DOUBLE AS n, TRUE AS {flag} FROM driver_train GROUP BY site_id", "driver_train", **others)


def optimal(fit, rows, x):
    """Whether emitted elastic-net coefficients meet the optimality conditions, all recomputed from the raw rows."""
    z = rows.join(fit.select(*common.FITS, "n", "coef", "alpha", "lambda"), list(common.FITS)).withColumn(
        "e", F.col("observation") - linalg.dot(F.col("coef"), linalg.with_intercept(x))
    )
    cells = z.select(*common.FITS, "n", "coef", "alpha", "lambda", "e", "observation", F.posexplode(x).alias("j", "v"))
    sums = cells.groupBy(*common.FITS, "n", "alpha", "lambda", "j").agg(
        F.covar_pop("v", "e").alias("ve"), F.stddev_pop("v").alias("sv"), F.stddev_pop("observation").alias("sy"),
        F.first(F.get("coef", F.col("j") + 1)).alias("c"), F.avg("e").alias("e"),
    )
    b = F.col("c") * F.col("sv") / F.col("sy")
    slope = F.try_divide(F.col("ve"), F.col("sv") * F.col("sy")) - F.col("lambda") * (1 - F.col("alpha")) * b
    bound = F.col("lambda") * F.col("alpha")
    off = F.when(F.col("c") != 0, F.abs(slope - bound * F.signum(b))).otherwise(F.greatest(F.abs(slope) - bound, F.lit(0.0)))
    level = F.abs(F.col("e")) / F.col("sy")
    return sums.groupBy("site_id", "n").agg((F.max(F.greatest(off, level)) < GAP).alias("optimal"))


def _elastic_net(v, monthly):
    fit = driver_models.elastic_net_fit(monthly, v.drivers, v.issues)
    rows = driver_models.driver_training(monthly, v.drivers, v.issues)
    return optimal(fit, rows, driver_models.predictors())


@query("elastic_net_fit", certificate_sql("optimal"))
def _(v):
    return _elastic_net(v, v.monthly)


@query("elastic_net_fit_suppliers", certificate_sql("optimal", monthly=SUPPLIER_MONTHLY))
def _(v):
    return _elastic_net(v, v.supplier_monthly)


@query("elastic_net_planted", tree_rows("closer_than_half"))
def _(v):
    """Coefficients of series that follow one driver, applied to the raw rows."""
    fit = driver_models.elastic_net_fit(v.planted_monthly, v.drivers, v.issues)
    rows = driver_models.driver_training(v.planted_monthly, v.drivers, v.issues).join(fit.select(*common.FITS, "coef"), list(common.FITS))
    predicted = linalg.dot(F.col("coef"), linalg.with_intercept(driver_models.predictors()))
    return _against_mean(rows.withColumn("prediction", predicted), "closer_than_half", 0.5)


def penalised(fit, rows):
    """Whether emitted coefficients on features ``x`` balance one penalty: from the raw rows, the residuals' products
    with the features are one multiple of the coefficients, and with the constant zero."""
    z = rows.join(fit.select(*common.FITS, "n", "coef"), list(common.FITS))
    z = z.withColumn("e", F.col("observation") - linalg.dot(F.col("coef"), linalg.with_intercept(F.col("x"))))
    cells = z.select(*common.FITS, "n", "coef", "e", "observation", F.posexplode(linalg.with_intercept(F.col("x"))).alias("j", "v"))
    sums = cells.groupBy(*common.FITS, "n", "j").agg(
        F.sum(F.col("v") * F.col("e")).alias("s"), F.first(F.get("coef", F.col("j"))).alias("c"),
        F.sqrt(F.sum(F.col("v") * F.col("v")) * F.sum(F.col("observation") * F.col("observation"))).alias("size"),
    )
    held = F.col("j") > 0
    ratio = F.try_divide(F.sum(F.when(held, F.col("s") * F.col("c"))), F.sum(F.when(held, F.col("c") * F.col("c"))))
    penalty = sums.groupBy(*common.FITS).agg(ratio.alias("penalty"))
    gap = F.abs(F.col("s") - F.when(held, F.col("penalty") * F.col("c")).otherwise(0.0)) / F.col("size")
    checked = sums.join(penalty, list(common.FITS)).groupBy("site_id", "n")
    return checked.agg(((F.max(gap) < GAP) & (F.min("penalty") > 0)).alias("normal_equations"))


def _features(v, stages):
    rows = driver_models.driver_training(v.monthly, v.drivers, v.issues)
    samples = driver_models.standardize(rows, common.FITS, driver_models.PREDICTORS).withColumn("x", driver_models.predictors())
    for stage in stages:
        samples = samples.withColumn("x", stage(F.col("x")))
    return samples


@query("kernel_ridge_fit", certificate_sql("normal_equations"))
def _(v):
    """Residuals recomputed from the raw rows: the coefficients solve a ridge problem, to one part in a million."""
    return penalised(driver_models.kernel_ridge_fit(v.monthly, v.drivers, v.issues), _features(v, driver_models.kernel_stages()))


@query("fc_kernel_ridge", member_sql("svm"))
def _(v):
    return shaped(MODELS["svm"](v.monthly, v.drivers, v.issues))


def _net_rows(v, monthly):
    """Training rows with the prediction of their fit's emitted net, evaluated in Spark."""
    fit = driver_models.bayes_net_fit(monthly, v.drivers, v.issues)
    rows = driver_models.standardize(driver_models.driver_training(monthly, v.drivers, v.issues), common.FITS, driver_models.PREDICTORS)
    joined = rows.join(fit.select(*common.FITS, "n", "units", "net", "middle", "half", "residual_sd"), list(common.FITS))
    return joined.withColumn("prediction", driver_models.net_output(driver_models.predictors()))


@query("bayes_net_fit", certificate_sql("residuals_recomputed"))
def _(v):
    """The reported spread is that of the emitted net's residuals over the raw rows."""
    rows = _net_rows(v, v.monthly).groupBy("site_id", "n", "residual_sd").agg(F.stddev_samp(F.col("prediction") - F.col("observation")).alias("sd"))
    return rows.select("site_id", "n", (F.abs(F.col("sd") - F.col("residual_sd")) <= GAP * F.col("sd")).alias("residuals_recomputed"))


@query("bayes_net_planted", tree_rows("closer_than_half"))
def _(v):
    return _against_mean(_net_rows(v, v.planted_monthly), "closer_than_half", 0.5)


@query("fc_bayes_net", member_sql("brnn"))
def _(v):
    return shaped(MODELS["brnn"](v.monthly, v.drivers, v.issues))


@query("fc_random_forest", member_sql("randomForest"))
def _(v):
    return shaped(MODELS["randomForest"](v.monthly, v.drivers, v.issues))


@query("fc_gbt", member_sql("XGBoost"))
def _(v):
    return shaped(MODELS["XGBoost"](v.monthly, v.drivers, v.issues))


def supplier_model(name: str, model: str):
    @query(name, member_sql(model, monthly=SUPPLIER_MONTHLY))
    def _(v):
        return shaped(MODELS[model](v.supplier_monthly, v.drivers, v.issues))


for _name, _model in (
    ("fc_random_forest", "randomForest"), ("fc_gbt", "XGBoost"), ("fc_elastic_net", "elasticNet"), ("fc_kernel_ridge", "svm"),
    ("fc_bayes_net", "brnn"),
):
    supplier_model(f"{_name}_suppliers", _model)
    replicate_model(_model, member_sql(_model, **REP_TRAIN))


@query("forest_out_of_bag", tree_rows("better_than_mean"))
def _(v):
    """Out-of-bag error of a series that follows one driver stays below the spread of the series."""
    return _against_mean(trees.fitted_rows(v.planted_monthly, v.drivers, v.issues), "better_than_mean")


@query("boosting_fit", tree_rows("closer_than_half"))
def _(v):
    return _against_mean(trees.fitted_rows(v.planted_monthly, v.drivers, v.issues, trees.boosting_solver()), "closer_than_half", 0.5)


@query(
    "pooled_fit",
    with_views(
        f"""SELECT issue, sum(n)::BIGINT AS n, count(*) AS sites, TRUE AS normal_equations FROM (
              SELECT site_id, issue, count(*) AS n FROM driver_rows JOIN ({ALL_ISSUES}) ON datetime < issue GROUP BY ALL HAVING count(*) >= 10)
            GROUP BY issue""",
        "driver_rows", train=(("monthly",), "SELECT * FROM monthly"),
    ),
)
def _(v):
    """All issue dates in one job; the residuals of the raw rows balance against every input."""
    rows = staged(trees.pooled_fit(v.monthly, v.drivers, v.backfill_issues), "pooled")
    checked = balanced(rows, F.col("x"), F.col("observation"), F.col("coef"), ["issue"])
    return rows.groupBy("issue").agg(F.count("*").alias("n"), F.count_distinct("site_id").alias("sites")).join(checked, "issue")


@query(
    "driver_importance",
    with_views(
        """SELECT site_id, name, TRUE AS ranked FROM (SELECT DISTINCT site_id FROM monthly JOIN treatments ON site_id = Plot WHERE CO2Treat = 'Amb'),
             (SELECT unnest(['Air temperature', 'Solar radiation', 'Precipitation', 'Wind speed', 'Air pressure']) AS name)""",
        "monthly", "treatments",
    ),
)
def _(v):
    rows = trees.driver_importance(v.monthly, v.drivers, v.treatments)
    return rows.select("site_id", "name", (F.col("IncMSE").isNotNull() & F.col("scaled").isNotNull()).alias("ranked"))


@query(
    "driver_importance_planted",
    with_views(
        "SELECT DISTINCT site_id, 'Air temperature' AS name FROM monthly JOIN treatments ON site_id = Plot WHERE CO2Treat = 'Amb'",
        "monthly", "treatments",
    ),
)
def _(v):
    """The driver that a series follows is the one whose shuffling costs most, at every site."""
    rows = trees.driver_importance(v.planted_monthly, v.drivers, v.treatments)
    return rows.groupBy("site_id").agg(F.max_by("name", "IncMSE").alias("name"))


def backfill_members(model: str) -> str:
    """Months of the latest ensemble from each issue date on, for every site with ten complete rows before it."""
    return with_views(
        f"""SELECT '{model}' AS model_id, site_id, datetime, issue AS reference_datetime, TRUE AS usable FROM (
              SELECT site_id, issue FROM driver_rows JOIN ({ALL_ISSUES}) ON datetime < issue GROUP BY ALL HAVING count(*) >= 10) JOIN (
              SELECT DISTINCT issue, datetime FROM driver_cells JOIN (
                SELECT issue, max(reference_datetime) AS latest FROM driver_cells JOIN ({ALL_ISSUES}) ON reference_datetime <= issue GROUP BY issue)
              ON reference_datetime = latest WHERE datetime >= issue) USING (issue)""",
        "driver_rows", "driver_cells", train=(("monthly",), "SELECT * FROM monthly"),
    )


def backfill_driver_model(model: str):
    @query(f"backfill_{model}", backfill_members(model))
    def _(v):
        path = scratch(v, f"backfill-{model}")
        errors = runs.backfill(v.spark, model, v.daily, v.drivers, path, *BACKFILL)
        assert errors.isEmpty()
        return shaped(v.spark.read.parquet(path))


for _model in ("randomForest", "XGBoost", "elasticNet", "svm", "brnn"):
    backfill_driver_model(_model)


# ---- runs -------------------------------------------------------------------------------------


@query("write_table", with_views(f"SELECT site_id, datetime, {R('observation')} AS observation, n FROM daily", "daily"))
def _(v):
    path = scratch(v, "table")
    tables.write_table(v.daily, path, "parquet")
    return rounds(v.spark.read.parquet(path).select("site_id", "datetime", "observation", "n"), "observation")


@query("register_model", with_views(f"SELECT 'last' AS model_id, site_id, DATE '2000-07-01' AS datetime, DATE '2000-07-01' AS reference_datetime, {R('arg_max(observation, datetime)')} AS mu, 1e0 AS sigma FROM train GROUP BY site_id", "train"))
def _(v):
    """A model given as a function runs through the same contract."""

    def last_value(monthly, drivers, issues):
        rows = common.training_window(monthly, issues)
        last = rows.groupBy(*common.FITS).agg(F.max_by("observation", "datetime").alias("mu"), F.lit(1.0).alias("sigma"))
        return common.finish_forecast(last.withColumn("datetime", F.col("issue")), "last")

    common.register_model("last", last_value)
    return rounds(runs.issue_forecast("last", v.daily, None, v.issues).select(*OUT), "mu")


SKILL_SQL = with_views(
    f"""SELECT Temp, series, {R('rmse')} AS rmse, {R('rmse / max(CASE WHEN Temp = 0 THEN rmse END) OVER ()', 6)} AS ratio FROM (
          SELECT Temp, median(rmse) AS rmse, count(*) AS series FROM (
            SELECT site_id, Temp, Veg, sqrt(avg((observation - mu) ** 2)) AS rmse FROM
              ({climatology_sql('monthly', ALL_ISSUES)}) f JOIN monthly o USING (site_id, datetime) JOIN treatments t ON site_id = Plot
            WHERE year(datetime) = 2000 AND round_even(date_diff('day', issue, datetime) / 30.5e0, 0) = 6 AND CO2Treat = 'Amb' GROUP BY ALL)
          GROUP BY Temp)""",
    "monthly", "treatments",
)


@query("forecast_skill_by_treatment", SKILL_SQL)
def _(v):
    """Raw measurements to monthly targets, climatology at 25 issue dates, scores and skill by treatment."""
    forecast = fc_climatology(v.monthly, None, v.backfill_issues)
    scores = scoring.score_distributions(forecast, v.monthly)
    formatted = scoring.format_scores(scores, v.treatments, SCORE_YEAR)
    table = skill.median_rmse_by_treatment(formatted)
    return rounds(rounds(table.select("Temp", "series", "rmse", "ratio"), "rmse"), "ratio", digits=6)
