"""Sources, cleaning, casts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom import schemas
from fluxloom.functions import dates, labels, values
from fluxloom.operators import aggregates as agg
from fluxloom.operators import cleaning, reshape
from fluxloom.operators.joins import join_drivers, load_treatments
from fluxloom.operators.reshape import unpivot_long
from fluxloom.session import fresh_path
from fluxloom.sources import grid, tables
from workload.registry import query, rounded, sql_rounded as R
from workload.views import ISSUE
from workload.views_sql import with_views


def scratch(views, name: str) -> str:
    """A fresh folder, in the shared folder the session names, for a query that reads files back."""
    return fresh_path(views.spark, name)


# ---- sources ----------------------------------------------------------------------------------


@query(
    "scan_text_csv",
    with_views(
        """SELECT "Date", Plot, Light, flux, CASE WHEN Light = 'Dark' THEN 'd' END AS note FROM raw_flux""", "raw_flux"
    ),
)
def _(v):
    """Two layouts, one with other column order and an extra column, found below one folder."""
    path = scratch(v, "raw")
    dark = F.col("Light") == "Dark"
    v.raw_flux.where(~F.coalesce(dark, F.lit(False))).write.option("header", True).option("nullValue", "NA").csv(
        f"{path}/a/final_CH4_fluxes_1"
    )
    v.raw_flux.where(dark).select("flux", F.lit("d").alias("note"), "Light", "Plot", "Date").write.option(
        "header", True
    ).option("nullValue", "NA").csv(f"{path}/b/final_CH4_fluxes_2")
    back = tables.scan_text_csv(v.spark, path, "*.csv")
    return back.select("Date", "Plot", "Light", F.coalesce("flux", F.lit("NA")).alias("flux"), "note")


@query(
    "scan_csv",
    with_views(
        f"SELECT project_id, site_id, datetime, duration, variable, {R('observation')} AS observation, n FROM daily",
        "daily",
    ),
)
def _(v):
    path = scratch(v, "targets")
    tables.write_table(v.daily, path, "csv")
    return tables.scan_csv(v.spark, path, schemas.TARGETS).withColumn("observation", rounded("observation"))


@query(
    "scan_forecasts",
    with_views(
        f"SELECT model_id, parameter, count(*) AS n, {R('sum(prediction)', 1)} AS total FROM forecasts GROUP BY ALL",
        "forecasts",
    ),
)
def _(v):
    """Gzip files of several models and one empty file, which is skipped by its size."""
    path = scratch(v, "outputs")
    columns = [c.split()[0] for c in schemas.FORECASTS.split(", ")]
    rows = v.forecasts.select(*columns)
    tables.write_table(rows, path, "csv.gz")
    back = tables.scan_forecasts(v.spark, path)
    return back.groupBy("model_id", "parameter").agg(
        F.count("*").alias("n"), rounded(F.sum("prediction"), 1).alias("total")
    )


@query(
    "flatten_grid",
    with_views(
        f"""SELECT r.reference_datetime, h::INTEGER AS horizon, p::INTEGER AS parameter,
               {R('g.Temp_K')} AS Temp_K, {R('g.SolarRad_Wm2')} AS SolarRad_Wm2
            FROM (SELECT DISTINCT reference_datetime FROM driver_cells) r CROSS JOIN (SELECT unnest(range(1, 7)) AS h)
            CROSS JOIN (SELECT unnest(range(0, 10)) AS p) LEFT JOIN driver_cells g
              ON g.reference_datetime = r.reference_datetime AND g.horizon = h AND g.parameter = p""",
        "driver_cells",
    ),
)
def _(v):
    rows = grid.flatten_grid(v.grid, ["horizon", "parameter"], ["Temp_K", "SolarRad_Wm2"])
    return rows.withColumns({c: rounded(c) for c in ("Temp_K", "SolarRad_Wm2")})


@query(
    "wrap_longitude",
    f"SELECT c_custkey, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon FROM (SELECT c_custkey, (c_custkey % 360)::DOUBLE AS lon FROM customer)",
)
def _(v):
    lon = (F.col("c_custkey") % 360).cast("double")
    return v.table("customer").select("c_custkey", values.wrap_longitude(lon).alias("lon"))


@query("epoch_to_date", "SELECT event_id, ts::DATE AS day FROM events")
def _(v):
    ts = F.col("ts")
    seconds = F.unix_date(F.to_date(ts)) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return v.table("events").select("event_id", dates.epoch_to_date(seconds).alias("day"))


@query(
    "select_cell",
    with_views(f"SELECT horizon, datetime, parameter, {R('Temp_K')} AS Temp_K FROM driver_cells WHERE parameter = 3 AND horizon = 2", "driver_cells"),
)
def _(v):
    cell = grid.select_cell(v.driver_cells, {"parameter": 3, "horizon": 2})
    return cell.select("horizon", "datetime", "parameter", rounded("Temp_K").alias("Temp_K"))


@query(
    "lead_to_valid_date",
    with_views("SELECT reference_datetime, horizon, count(*) AS n, (reference_datetime + to_months(horizon))::DATE AS valid FROM driver_cells GROUP BY ALL", "driver_cells"),
)
def _(v):
    valid = dates.lead_to_valid_date(F.col("reference_datetime"), F.col("horizon"))
    return v.driver_cells.groupBy("reference_datetime", "horizon", valid.alias("valid")).agg(F.count("*").alias("n"))


@query(
    "load_treatments",
    with_views(
        """SELECT t.*, n AS orders FROM treatments t JOIN (
             SELECT unnest([Plot, substr(Plot, 1, 1) || substr(Plot, 3, 1)]) AS Plot, count(*) AS n FROM measured GROUP BY 1) m USING (Plot)""",
        "treatments", "measured",
    ),
)
def _(v):
    """Both levels of the treatment table with the number of orders behind each row."""
    levels = F.explode(F.array(F.col("Plot"), values.rep_group_code(F.col("Plot")))).alias("Plot")
    counts = v.measured.select(levels).groupBy("Plot").agg(F.count("*").alias("orders"))
    return load_treatments(v.plots).join(counts, "Plot")


# ---- cleaning ---------------------------------------------------------------------------------


@query(
    "parse_mixed_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate::DATE END AS d FROM orders""",
)
def _(v):
    text = (
        F.when(F.col("o_orderkey") % 7 == 0, "no date")
        .when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    return v.table("orders").select("o_orderkey", dates.parse_mixed_date(text).alias("d"))


@query(
    "to_double_or_null",
    with_views("SELECT Plot, \"Date\", TRY_CAST(flux AS DOUBLE) AS flux FROM raw_flux", "raw_flux"),
)
def _(v):
    return v.raw_flux.select("Plot", "Date", values.to_double_or_null(F.col("flux")).alias("flux"))


@query(
    "apply_exclusions",
    with_views(
        """SELECT p."Date", p.Plot, count(*) AS n, count(CASE WHEN EXISTS (SELECT 1 FROM exclusions e WHERE e.date = p."Date"
             AND (e.plot IS NULL OR e.plot = p.Plot)) THEN NULL ELSE p.flux END) AS kept FROM parsed p GROUP BY ALL""",
        "parsed", "exclusions",
    ),
)
def _(v):
    parsed = v.raw_flux.withColumns(
        {"Date": dates.parse_mixed_date(F.col("Date")), "flux": values.to_double_or_null(F.col("flux"))}
    )
    kept = cleaning.apply_exclusions(parsed, v.exclusions)
    return kept.groupBy("Date", "Plot").agg(F.count("*").alias("n"), F.count("flux").alias("kept"))


@query("filter_dark", with_views("SELECT \"Date\", Plot, Light, flux FROM raw_flux WHERE Light IS NULL OR Light = 'Dark'", "raw_flux"))
def _(v):
    return cleaning.filter_dark(v.raw_flux)


@query(
    "drop_null_targets",
    with_views("SELECT \"Date\" AS datetime, Plot AS site_id, flux AS observation FROM clean WHERE flux IS NOT NULL AND \"Date\" IS NOT NULL", "clean"),
)
def _(v):
    named = v.clean.select(F.col("Date").alias("datetime"), F.col("Plot").alias("site_id"), F.col("flux").alias("observation"))
    return cleaning.drop_null_targets(named)


@query(
    "filter_years",
    "SELECT o_orderkey, o_orderdate::DATE AS datetime FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 AND year(o_orderdate) <> 1998",
)
def _(v):
    rows = v.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("datetime"))
    return cleaning.exclude_year(cleaning.filter_years(rows, 1996, 1999), 1998)


DRIVER_ROW = ("site_id", "datetime", "observation", "Temp_K", "SoilTemp_K")


@query(
    "drop_incomplete",
    with_views(
        f"""SELECT m.site_id, m.datetime, {R('m.observation')} AS observation, {R('Temp_K')} AS Temp_K, {R('SoilTemp_K')} AS SoilTemp_K
            FROM all_monthly m JOIN past_drivers p USING (datetime)
            WHERE Temp_K IS NOT NULL AND SoilTemp_K IS NOT NULL AND WindSpeed_ms IS NOT NULL""",
        "all_monthly", "past_drivers",
    ),
)
def _(v):
    joined = join_drivers(v.all_monthly, agg.past_driver_mean(v.drivers))
    rows = cleaning.drop_incomplete(joined)
    return rows.select("site_id", "datetime", *[rounded(c).alias(c) for c in DRIVER_ROW[2:]])


@query(
    "min_rows_per_key",
    with_views(
        f"""SELECT site_id, datetime, {R('observation')} AS observation FROM monthly WHERE site_id IN
            (SELECT site_id FROM monthly GROUP BY 1 HAVING count(observation) >= 78)""",
        "monthly",
    ),
)
def _(v):
    rows = cleaning.min_rows_per_key(v.monthly, ["site_id"], "observation", 78)
    return rows.select("site_id", "datetime", rounded("observation").alias("observation"))


@query(
    "exclude_models",
    with_views("SELECT model_id, site_id, datetime, reference_datetime FROM (SELECT * REPLACE (nullif(model_id, 'svm') AS model_id) FROM fixture_dist) WHERE model_id IS NULL OR model_id NOT IN ('persistence', 'met_lm_step', 'randomForestLog', 'cwae', 'lasso', 'ridge')", "fixture_dist"),
)
def _(v):
    rows = v.fixture_dist.withColumn("model_id", F.nullif("model_id", F.lit("svm")))
    return cleaning.exclude_models(rows).select("model_id", "site_id", "datetime", "reference_datetime")


@query("sentinel_to_null", with_views("SELECT SampleID, umol_CH4 FROM porewater WHERE umol_CH4 <> -99", "porewater"))
def _(v):
    return cleaning.sentinel_to_null(v.porewater, "umol_CH4").select("SampleID", "umol_CH4")


@query("clean_porewater", with_views("SELECT SampleID, Plot, Month, Temperature, Vegetation, CH4, datetime FROM porewater_clean", "porewater_clean"))
def _(v):
    """Two vintages: the older one lacks a column and names the value differently."""
    odd = F.col("SampleID") % 2 == 1
    vintages = [v.porewater.where(odd).withColumnRenamed("umol_CH4", "CH4"), v.porewater.where(~odd).withColumn("Type", F.lit("Original"))]
    out = cleaning.clean_porewater(vintages)
    return out.select("SampleID", "Plot", "Month", "Temperature", "Vegetation", "CH4", "datetime")


# ---- projection, reshape, scalar functions ----------------------------------------------------


@query(
    "project",
    with_views("SELECT 'project' AS project_id, Plot AS site_id, \"Date\" AS datetime, 'P1M' AS duration, flux FROM raw_flux", "raw_flux"),
)
def _(v):
    return reshape.project(
        v.raw_flux, keep=["Date", "Plot", "flux", "Light"], drop=["Light"],
        rename={"Plot": "site_id", "Date": "datetime"}, tags={"project_id": "project", "duration": "P1M"},
    )


@query("month_floor", "SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1")
def _(v):
    return v.table("orders").groupBy(dates.month_floor(F.col("o_orderdate")).alias("month")).agg(F.count("*").alias("n"))


@query(
    "date_parts",
    """SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, day(o_orderdate)::INTEGER AS day,
       dayofyear(o_orderdate)::INTEGER AS yday, strftime(o_orderdate, '%m') AS month_text FROM orders""",
)
def _(v):
    return v.table("orders").select("o_orderkey", *[c.alias(n) for n, c in dates.date_parts(F.col("o_orderdate")).items()])


@query("pseudo_year_date", "SELECT o_orderkey, (DATE '2024-01-01' + (dayofyear(o_orderdate) - 1)::INTEGER)::DATE AS yday FROM orders")
def _(v):
    return v.table("orders").select("o_orderkey", dates.pseudo_year_date(F.col("o_orderdate")).alias("yday"))


@query(
    "horizon_months",
    with_views("SELECT DISTINCT reference_datetime, datetime, round_even(date_diff('day', reference_datetime, datetime) / 30.5e0, 0)::INTEGER AS horizon FROM fixture_dist", "fixture_dist"),
)
def _(v):
    lead = dates.horizon_months(F.col("reference_datetime"), F.col("datetime"))
    return v.fixture_dist.select("reference_datetime", "datetime", lead.alias("horizon")).distinct()


@query(
    "steps_to_issue",
    with_views(
        """SELECT site_id, max(datetime) AS last, (7 - month(max(datetime)) + 12 * (2000 - year(max(datetime))) + 6)::INTEGER AS h
           FROM train GROUP BY site_id""",
        "train",
    ),
)
def _(v):
    last = v.until_issue().groupBy("site_id").agg(F.max("datetime").alias("last"))
    return last.withColumn("h", dates.steps_to_issue(F.col("last"), F.lit(ISSUE)))


@query("rep_group_code", with_views("SELECT o_orderkey, substr(Plot, 1, 1) || substr(Plot, 3, 1) AS code FROM measured", "measured"))
def _(v):
    return v.measured.select("o_orderkey", values.rep_group_code(F.col("Plot")).alias("code"))


@query(
    "recode",
    with_views(
        """SELECT model_id, count(*) AS n, CASE model_id WHEN 'climatology' THEN 'Climatology' WHEN 'auto.arima' THEN 'ARIMA'
             WHEN 'ets' THEN 'ETS' WHEN 'prophet' THEN 'Prophet' WHEN 'rEDM' THEN 'EDM' WHEN 'elasticNet' THEN 'Elastic Net'
             WHEN 'randomForest' THEN 'RF' WHEN 'brnn' THEN 'BRNN' WHEN 'XGBoost' THEN 'XGBoost' WHEN 'svm' THEN 'SVM' END AS name
           FROM fixture_dist GROUP BY ALL""",
        "fixture_dist",
    ),
)
def _(v):
    counts = v.fixture_dist.groupBy("model_id").agg(F.count("*").alias("n"))
    return counts.withColumn("name", labels.recode(F.col("model_id"), labels.MODEL_NAMES))


@query(
    "recode_drivers",
    with_views(
        """SELECT variable, count(*) AS n, CASE variable WHEN 'Temp_K' THEN 'Air temperature' WHEN 'SolarRad_Wm2' THEN 'Solar radiation'
             WHEN 'PrecipRate_ms' THEN 'Precipitation' WHEN 'WindSpeed_ms' THEN 'Wind speed' WHEN 'Pressure_Pa' THEN 'Air pressure' END AS name
           FROM drivers GROUP BY ALL""",
        "drivers",
    ),
)
def _(v):
    counts = v.drivers.groupBy("variable").agg(F.count("*").alias("n"))
    return counts.withColumn("name", labels.recode(F.col("variable"), labels.DRIVER_LABELS))


@query(
    "model_type",
    with_views(
        """SELECT DISTINCT model_id, CASE WHEN model_id IN ('auto.arima', 'ets', 'prophet', 'rEDM') THEN 'time series'
             WHEN model_id = 'climatology' THEN 'climatology'
             WHEN model_id IN ('randomForest', 'brnn', 'XGBoost', 'svm', 'elasticNet') THEN 'machine learning' END AS model_type FROM fixture_dist""",
        "fixture_dist",
    ),
)
def _(v):
    return v.fixture_dist.select("model_id").distinct().withColumn("model_type", labels.model_type(F.col("model_id")))


@query("fold_transect", with_views("SELECT c_custkey, CASE WHEN Transect > 3 THEN Transect - 3 ELSE Transect END AS folded FROM sited_customers", "sited_customers"))
def _(v):
    return v.sited_customers.select("c_custkey", values.fold_transect(F.col("Transect")).alias("folded"))


@query(
    "labels",
    with_views(
        """SELECT c_custkey, '''''+' || CASE WHEN Temp = floor(Temp) THEN CAST(floor(Temp)::INTEGER AS VARCHAR) ELSE CAST(Temp AS VARCHAR) END || '~degree~C' AS temp_label,
             COALESCE(CAST(nullif(Transect, 5) AS VARCHAR), 'NA') || ' ' || Plot AS line, CASE Veg WHEN 'C3' THEN 'C[3]' WHEN 'C4' THEN 'C[4]' END AS veg_label,
             CASE Veg WHEN 'C3' THEN 1 WHEN 'C4' THEN 2 END AS veg_rank FROM sited_customers""",
        "sited_customers",
    ),
)
def _(v):
    return v.sited_customers.select(
        "c_custkey",
        labels.temperature_label(F.col("Temp")).alias("temp_label"),
        labels.paste(F.nullif(F.col("Transect"), F.lit(5)), F.col("Plot"), sep=" ").alias("line"),
        labels.recode(F.col("Veg"), labels.VEGETATION_LABELS).alias("veg_label"),
        labels.ordinal(F.col("Veg"), labels.VEGETATION_LABELS).alias("veg_rank"),
    )


@query(
    "classify_coef",
    """SELECT DISTINCT o_orderpriority AS name, CASE WHEN contains(o_orderpriority, 's') THEN 'Seasonal' ELSE 'Non-seasonal' END AS Type,
         regexp_replace(o_orderpriority, 's', '') AS base FROM (SELECT lower(o_orderpriority) AS o_orderpriority FROM orders)""",
)
def _(v):
    names = v.table("orders").select(F.lower("o_orderpriority").alias("name")).distinct()
    return names.withColumns(
        {"Type": labels.coefficient_type(F.col("name")), "base": labels.coefficient_base(F.col("name"))}
    )


@query(
    "unpivot_long",
    with_views(f"SELECT horizon, reference_datetime, parameter, datetime, variable, {R('prediction')} AS prediction FROM drivers", "drivers"),
)
def _(v):
    long = unpivot_long(v.driver_cells, agg.DRIVER_VARIABLES, "variable", "prediction")
    return long.withColumn("prediction", rounded("prediction"))


@query(
    "pivot_wide",
    with_views(f"SELECT project_id, model_id, datetime, reference_datetime, site_id, {R('mu')} AS mu, {R('sigma')} AS sigma FROM fixture_dist", "fixture_dist"),
)
def _(v):
    keys = ["project_id", "model_id", "datetime", "reference_datetime", "site_id"]
    wide = reshape.pivot_wide(v.forecasts, keys, "parameter", "prediction", ["mu", "sigma"])
    return wide.withColumns({c: rounded(c) for c in ("mu", "sigma")})


SPREAD_SQL = """
    SELECT Temp, round_even(quantile_cont(observation, 0.5), 0) AS median,
           round_even(quantile_cont(observation, 0.75) - quantile_cont(observation, 0.25), 0) AS iqr
    FROM monthly m JOIN treatments t ON m.site_id = t.Plot WHERE CO2 = 0 AND Temp IN (0, 5.1) GROUP BY Temp
"""


@query(
    "transpose_compare",
    with_views(
        f"""SELECT name, low, high, round_even(high / low, 1) AS dif FROM (
              SELECT name, max(CASE WHEN Temp = 0 THEN value END) AS low, max(CASE WHEN Temp > 5 THEN value END) AS high
              FROM ({SPREAD_SQL}) UNPIVOT (value FOR name IN (median, iqr)) GROUP BY name)""",
        "monthly", "treatments",
    ),
)
def _(v):
    return reshape.transpose_compare(agg.treatment_spread(v.monthly, v.treatments), "Temp", ["median", "iqr"], 0.0, 5.1)


@query(
    "math_functions",
    f"""SELECT c_custkey, {R('ln(abs(c_acctbal) + 1)', 6)} AS ln, {R('exp(c_acctbal / 10000e0)', 6)} AS exp, {R('sqrt(abs(c_acctbal))', 6)} AS sqrt,
          {R('c_acctbal * c_acctbal', 2)} AS square, round_even(c_acctbal, 0) AS r0 FROM customer""",
)
def _(v):
    x = F.col("c_acctbal")
    return v.table("customer").select(
        "c_custkey",
        rounded(F.log(F.abs(x) + 1), 6).alias("ln"),
        rounded(F.exp(x / 10000), 6).alias("exp"),
        rounded(F.sqrt(F.abs(x)), 6).alias("sqrt"),
        rounded(x * x, 2).alias("square"),
        F.bround(x, 0).alias("r0"),
    )
