"""The same input views as common table expressions, written independently of the Spark operators."""

from __future__ import annotations

from workload.views import CATALOG, EXCLUSIONS, FIXTURE_MODELS

_exclusions = ", ".join(
    f"(DATE '{d}', {'NULL' if p is None else repr(p)})" for d, p in EXCLUSIONS
)
_catalog = ", ".join(f"('{m}', DATE '{d}', '{v}', TIMESTAMP '{t}')" for m, d, v, t in CATALOG)
_models = ", ".join(f"'{m}'" for m in FIXTURE_MODELS)

ERF = """(sign({x}) * (1 - ((((1.061405429e0 * t_({x}) - 1.453152027e0) * t_({x}) + 1.421413741e0) * t_({x})
 - 0.284496736e0) * t_({x}) + 0.254829592e0) * t_({x}) * exp(-({x}) * ({x}))))"""


def erf(x: str) -> str:
    t = f"(1e0 / (1 + 0.3275911e0 * abs({x})))"
    return ERF.format(x=x).replace(f"t_({x})", t)


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "site_dim": (
        (),
        """
        SELECT n_nationkey, CAST(head * 100 + tr * 10 + lvl AS VARCHAR) AS Plot, 'T' || lvl AS Treat,
               CASE lvl WHEN 0 THEN 0e0 WHEN 1 THEN 1.7e0 WHEN 2 THEN 3.4e0 WHEN 3 THEN 5.1e0 END AS Temp,
               CASE WHEN n_regionkey = 4 OR tr <= 3 THEN 'C3' ELSE 'C4' END AS Veg,
               CASE WHEN n_regionkey = 4 THEN 1 ELSE 0 END::INTEGER AS CO2,
               CASE WHEN n_regionkey = 4 THEN 'Elev' ELSE 'Amb' END AS CO2Treat, tr::INTEGER AS Transect
        FROM (SELECT *, CASE WHEN n_regionkey = 4 THEN 6 WHEN tr <= 3 THEN 3 ELSE 4 END AS head,
                     CASE WHEN n_regionkey = 4 THEN 0 ELSE n_regionkey END AS lvl
              FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS tr FROM nation))
        """,
    ),
    "treatments": (
        ("site_dim",),
        """
        SELECT Plot, Treat, Temp, Veg, CO2, CO2Treat, Transect, 'Separate' AS Type FROM site_dim
        UNION ALL
        SELECT DISTINCT substr(Plot, 1, 1) || substr(Plot, 3, 1), Treat, Temp, Veg, CO2, CO2Treat,
               NULL::INTEGER, 'Rep_comb' FROM site_dim
        """,
    ),
    "sited_customers": (
        ("site_dim",),
        "SELECT c.*, s.* FROM customer c JOIN site_dim s ON c.c_nationkey = s.n_nationkey",
    ),
    "measured": (
        ("site_dim",),
        """SELECT o.*, s.Plot FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
           JOIN site_dim s ON c.c_nationkey = s.n_nationkey""",
    ),
    "raw_flux": (
        ("measured",),
        """
        SELECT CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%-m/%-d/%Y')
                    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS "Date",
               Plot, CASE o_orderstatus WHEN 'F' THEN 'Dark' WHEN 'O' THEN 'Light' END AS Light,
               CASE WHEN o_orderkey % 50 = 0 THEN 'NA' ELSE CAST(o_totalprice AS VARCHAR) END AS flux
        FROM measured
        """,
    ),
    "exclusions": ((), f"SELECT * FROM (VALUES {_exclusions}) AS t(date, plot)"),
    "catalog": (
        (),
        f"SELECT * FROM (VALUES {_catalog}) AS t(model_id, reference_datetime, variant, modified_at)",
    ),
    "parsed": (
        ("raw_flux",),
        """
        SELECT COALESCE(try_strptime("Date", '%m/%d/%Y'), try_strptime("Date", '%Y-%m-%d'))::DATE AS "Date",
               Plot, Light, TRY_CAST(flux AS DOUBLE) AS flux FROM raw_flux
        """,
    ),
    "clean": (
        ("parsed", "exclusions"),
        """
        SELECT p."Date", p.Plot,
               CASE WHEN EXISTS (SELECT 1 FROM exclusions e WHERE e.date = p."Date"
                                 AND (e.plot IS NULL OR e.plot = p.Plot)) THEN NULL ELSE p.flux END AS flux
        FROM parsed p WHERE p.Light IS NULL OR p.Light = 'Dark'
        """,
    ),
    "long": (
        ("clean",),
        """
        SELECT 'project' AS project_id, Plot AS site_id, "Date" AS datetime, 'P1M' AS duration,
               'CH4_slope_umol_m2_d' AS variable, flux AS observation
        FROM clean WHERE flux IS NOT NULL AND "Date" IS NOT NULL AND year("Date") BETWEEN 1995 AND 2001
        """,
    ),
    "daily": (
        ("long",),
        """
        SELECT project_id, site_id, datetime, duration, variable, median(observation) AS observation, count(*) AS n
        FROM long GROUP BY ALL
        """,
    ),
    "monthly": (
        ("daily",),
        """
        SELECT project_id, site_id, date_trunc('month', datetime)::DATE AS datetime, duration, variable,
               avg(observation) AS observation FROM daily GROUP BY ALL
        """,
    ),
    "rep_monthly": (
        ("monthly",),
        """
        SELECT project_id, substr(site_id, 1, 1) || substr(site_id, 3, 1) AS site_id, datetime, duration, variable,
               avg(observation) AS observation FROM monthly GROUP BY ALL
        """,
    ),
    "all_monthly": (
        ("monthly", "rep_monthly"),
        "SELECT * FROM monthly UNION ALL SELECT * FROM rep_monthly",
    ),
    "driver_cells": (
        (),
        """
        SELECT h::INTEGER AS horizon, (m - to_months(h::INTEGER))::DATE AS reference_datetime, parameter, m AS datetime,
               avg(l_quantity) AS Temp_K, avg(l_tax) AS Pressure_Pa, avg(l_suppkey::DOUBLE) AS SoilTemp_K,
               avg(l_extendedprice) AS SolarRad_Wm2, avg(l_discount) AS PrecipRate_ms,
               avg((l_partkey % 100)::DOUBLE) AS WindSpeed_ms
        FROM (SELECT *, (l_linenumber - 1) % 6 + 1 AS h, date_trunc('month', l_shipdate)::DATE AS m,
                     (l_suppkey % 10)::INTEGER AS parameter FROM lineitem)
        GROUP BY 1, 2, 3, 4
        """,
    ),
    "drivers": (
        ("driver_cells",),
        """
        SELECT horizon, reference_datetime, parameter, datetime, 'seasonal-ensemble' AS model_id, variable, prediction
        FROM driver_cells UNPIVOT (prediction FOR variable IN
             (Temp_K, Pressure_Pa, SoilTemp_K, SolarRad_Wm2, PrecipRate_ms, WindSpeed_ms))
        """,
    ),
    "past_drivers": (
        ("driver_cells",),
        """
        SELECT datetime, avg(Temp_K) AS Temp_K, avg(Pressure_Pa) AS Pressure_Pa, avg(SoilTemp_K) AS SoilTemp_K,
               avg(SolarRad_Wm2) AS SolarRad_Wm2, avg(PrecipRate_ms) AS PrecipRate_ms, avg(WindSpeed_ms) AS WindSpeed_ms
        FROM driver_cells WHERE horizon = 1 GROUP BY datetime
        """,
    ),
    "porewater": (
        (),
        """
        SELECT year(ts)::INTEGER AS Year, strftime(ts, '%B') AS Month, day(ts)::INTEGER AS Day,
               CAST(user_id AS VARCHAR) AS Plot, (user_id % 4)::INTEGER AS Temperature, 0 AS CO2,
               (3 + user_id % 2)::INTEGER AS Vegetation,
               CASE event_type WHEN 'click' THEN 10 WHEN 'error' THEN 20 WHEN 'purchase' THEN 40
                    WHEN 'signup' THEN 80 WHEN 'view' THEN 120 END AS Depth,
               event_id AS SampleID, CASE WHEN event_id % 40 = 0 THEN -99e0 ELSE value END AS umol_CH4
        FROM events
        """,
    ),
    "porewater_clean": (
        ("porewater",),
        """
        SELECT Year, Month, Day, Plot,
               CASE Temperature WHEN 0 THEN 0e0 WHEN 1 THEN 1.7e0 WHEN 2 THEN 3.4e0 WHEN 3 THEN 5.1e0 END AS Temperature,
               CO2, Vegetation, Depth, SampleID, umol_CH4 AS CH4,
               strptime(Year || ' ' || Month || ' ' || Day, '%Y %B %d')::DATE AS datetime
        FROM porewater WHERE umol_CH4 <> -99 AND CO2 = 0 AND Depth = 20
        """,
    ),
    "fixture_dist": (
        ("measured",),
        f"""
        SELECT 'project' AS project_id, model_id, datetime, reference_datetime, site_id, 'P1M' AS duration,
               'normal' AS family, 'CH4_slope_umol_m2_d' AS variable, avg(o_totalprice) AS mu,
               max(o_totalprice) - min(o_totalprice) + 1000e0 AS sigma
        FROM (SELECT [{_models}][(o_custkey % 11)::INTEGER + 1] AS model_id, m AS datetime,
                     (m - to_months((o_orderkey % 8)::INTEGER))::DATE AS reference_datetime,
                     unnest([Plot, substr(Plot, 1, 1) || substr(Plot, 3, 1)]) AS site_id, o_totalprice
              FROM (SELECT *, date_trunc('month', o_orderdate)::DATE AS m FROM measured))
        GROUP BY ALL
        """,
    ),
    "forecasts": (
        ("fixture_dist",),
        """
        SELECT project_id, model_id, datetime, reference_datetime, duration, site_id, family, variable, parameter,
               prediction FROM fixture_dist UNPIVOT (prediction FOR parameter IN (mu, sigma))
        """,
    ),
    "scores": (
        ("fixture_dist", "all_monthly"),
        f"""
        SELECT *, mu AS mean, sigma AS sd, date_diff('day', reference_datetime, datetime)::INTEGER AS horizon,
               sigma * (z * {erf("(z / sqrt(2e0))")} + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())) AS crps,
               ln(2 * pi() * sigma * sigma) / 2 + z * z / 2 AS logs
        FROM (SELECT f.*, o.observation, (o.observation - f.mu) / f.sigma AS z
              FROM fixture_dist f JOIN all_monthly o USING (project_id, site_id, datetime, duration, variable))
        """,
    ),
    "formatted": (
        ("scores", "treatments"),
        """
        SELECT s.* EXCLUDE (horizon, model_id, z),
               CAST(round_even(date_diff('day', reference_datetime, datetime) / 30.5e0, 0) AS INTEGER) AS horizon,
               t.Treat, t.Temp, t.Veg, t.CO2, t.CO2Treat, t.Transect, t.Type, year(datetime)::INTEGER AS year,
               CASE WHEN s.model_id IN ('auto.arima', 'ets', 'prophet', 'rEDM') THEN 'time series'
                    WHEN s.model_id = 'climatology' THEN 'climatology'
                    WHEN s.model_id IN ('randomForest', 'brnn', 'XGBoost', 'svm', 'elasticNet')
                    THEN 'machine learning' END AS model_type,
               CASE s.model_id WHEN 'climatology' THEN 'Climatology' WHEN 'auto.arima' THEN 'ARIMA'
                    WHEN 'ets' THEN 'ETS' WHEN 'prophet' THEN 'Prophet' WHEN 'rEDM' THEN 'EDM'
                    WHEN 'elasticNet' THEN 'Elastic Net' WHEN 'randomForest' THEN 'RF' WHEN 'brnn' THEN 'BRNN'
                    WHEN 'XGBoost' THEN 'XGBoost' WHEN 'svm' THEN 'SVM' END AS model_id
        FROM scores s LEFT JOIN treatments t ON s.site_id = t.Plot
        WHERE s.horizon > 0 AND year(datetime) = 2000
          AND (s.model_id IS NULL OR s.model_id NOT IN
               ('persistence', 'met_lm_step', 'randomForestLog', 'cwae', 'lasso', 'ridge'))
        """,
    ),
    "rmse_sep": (
        ("formatted",),
        """
        SELECT horizon, site_id, model_id, Temp, year, CO2Treat, Veg, sqrt(avg((observation - mean) ** 2)) AS rmse,
               count(*) AS n
        FROM formatted WHERE horizon = 6 AND CO2Treat = 'Amb' AND Type = 'Separate' GROUP BY ALL
        """,
    ),
    "sites_complete": (
        ("monthly",),
        """
        SELECT c.site_id, c.datetime, m.observation FROM (
            SELECT site_id, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 MONTH))::DATE AS datetime
            FROM monthly GROUP BY site_id) c LEFT JOIN monthly m USING (site_id, datetime)
        """,
    ),
    "fixed_complete": (
        ("monthly",),
        """
        SELECT site_id, datetime, m.observation FROM (
            SELECT s.site_id, g.datetime FROM (SELECT DISTINCT site_id FROM monthly) s CROSS JOIN
              (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2000-12-01', INTERVAL 1 MONTH))::DATE AS datetime) g
        ) FULL JOIN monthly m USING (site_id, datetime)
        """,
    ),
    "train": (
        ("monthly",),
        "SELECT site_id, datetime, observation FROM monthly WHERE datetime < DATE '2000-07-01'",
    ),
    "train_ok": (
        ("train",),
        "SELECT * FROM train WHERE site_id IN (SELECT site_id FROM train GROUP BY 1 HAVING count(observation) >= 5)",
    ),
    "train_complete": (
        ("train_ok",),
        """
        SELECT c.site_id, c.datetime, m.observation FROM (
            SELECT site_id, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 MONTH))::DATE AS datetime
            FROM train_ok GROUP BY site_id) c LEFT JOIN train_ok m USING (site_id, datetime)
        """,
    ),
    "train_filled": (
        ("train_complete",),
        """
        SELECT site_id, datetime, k,
               CASE WHEN y IS NOT NULL THEN y WHEN ya IS NULL THEN yb WHEN yb IS NULL THEN ya
                    ELSE ya + (yb - ya) * (CAST(k - ka AS DOUBLE) / (kb - ka)) END AS y
        FROM (SELECT *, max(CASE WHEN y IS NOT NULL THEN k END) OVER b AS ka, min(CASE WHEN y IS NOT NULL THEN k END) OVER a AS kb,
                     last_value(y IGNORE NULLS) OVER b AS ya, first_value(y IGNORE NULLS) OVER a AS yb
              FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY datetime) AS k,
                           COALESCE(observation, avg(observation) OVER (PARTITION BY site_id, month(datetime))) AS y
                    FROM train_complete)
              WINDOW b AS (PARTITION BY site_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                     a AS (PARTITION BY site_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        """,
    ),
    "driver_rows": (
        ("train", "past_drivers"),
        """
        SELECT t.*, p.* EXCLUDE (datetime) FROM train t JOIN past_drivers p USING (datetime)
        WHERE Temp_K IS NOT NULL AND SoilTemp_K IS NOT NULL AND observation IS NOT NULL
        """,
    ),
    "driver_train": (
        ("driver_rows",),
        "SELECT * FROM driver_rows WHERE site_id IN (SELECT site_id FROM driver_rows GROUP BY 1 HAVING count(*) >= 10)",
    ),
    "future": (
        ("driver_cells",),
        """
        SELECT DATE '2000-07-01' AS issue, * FROM driver_cells WHERE reference_datetime =
          (SELECT max(reference_datetime) FROM driver_cells WHERE reference_datetime <= DATE '2000-07-01')
        """,
    ),
}


#: Monthly quantity of each supplier, in the form of the monthly targets: series that grow with the data.
SUPPLIER_MONTHLY = (
    (),
    """
    SELECT 'project' AS project_id, l_suppkey::VARCHAR AS site_id, date_trunc('month', l_shipdate)::DATE AS datetime,
           'P1M' AS duration, 'quantity' AS variable, sum(l_quantity)::DOUBLE AS observation FROM lineitem GROUP BY ALL
    """,
)


def with_views(body: str, *names: str, recursive: bool = False, **others: tuple) -> str:
    """``body`` preceded by the named views and all they build on; ``others`` take the place of views of that name."""
    ordered: list[str] = []
    views = {**VIEWS, **others}

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dependency in views[name][0]:
            visit(dependency)
        ordered.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{n} AS ({views[n][1]})" for n in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"
