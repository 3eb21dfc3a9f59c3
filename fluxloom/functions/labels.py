"""Display names and recodes.

The tables below are fixed values: outputs must carry exactly these texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------------------------
MODEL_NAMES = {
    "climatology": "Climatology",
    "auto.arima": "ARIMA",
    "ets": "ETS",
    "prophet": "Prophet",
    "rEDM": "EDM",
    "elasticNet": "Elastic Net",
    "randomForest": "RF",
    "brnn": "BRNN",
    "XGBoost": "XGBoost",
    "svm": "SVM",
}
MODEL_TYPES = {
    "time series": ["auto.arima", "ets", "prophet", "rEDM"],
    "climatology": ["climatology"],
    "machine learning": ["randomForest", "brnn", "XGBoost", "svm", "elasticNet"],
}
OBSOLETE_MODELS = ["persistence", "met_lm_step", "randomForestLog", "cwae", "lasso", "ridge"]
VEGETATION_LABELS = {"C3": "C[3]", "C4": "C[4]"}
VEGETATION_CODES = {"3": "C[3]", "4": "C[4]"}
CO2_LABELS = {"Amb": "Ambient~CO[2]", "Elev": "Elevated~CO[2]"}
TEMPERATURE_LEVELS = {0: 0.0, 1: 1.7, 2: 3.4, 3: 5.1}
DRIVER_LABELS = {
    "Temp_K": "Air temperature",
    "SolarRad_Wm2": "Solar radiation",
    "PrecipRate_ms": "Precipitation",
    "WindSpeed_ms": "Wind speed",
    "Pressure_Pa": "Air pressure",
}
METRIC_LABELS = {
    "bias": "Bias",
    "crps": "CRPS",
    "grmse": "Geometric~RMSE",
    "r2": "R^{2}",
    "rmse_mean": "RMSE/mean",
    "ign": "Ignorance",
    "sd": "SD",
}
STATISTIC_LABELS = {
    "mean": "Mean",
    "median": "Median",
    "sd": "SD",
    "IQR": "IQR",
    "stability": "Stability",
    "acf1": "ACF1",
    "acf12": "ACF12",
}
COLWELL_LABELS = {"C": "Constancy", "M": "Contingency", "P": "Predictability"}
# -----------------------------------------------------------------------------------------------


def recode(c: Column, mapping: dict) -> Column:
    """Look a value up in a literal table; no match gives null."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(table, c)


def ordinal(c: Column, mapping: dict) -> Column:
    """Position of a value in a label table, for sorting by display order."""
    return recode(c, {key: i for i, key in enumerate(mapping, start=1)})


def model_type(model_id: Column) -> Column:
    return recode(model_id, {m: kind for kind, models in MODEL_TYPES.items() for m in models})


def temperature_label(temp: Column) -> Column:
    """Treatment label; whole degrees print without a decimal point, a missing one as NA."""
    number = F.when(temp == F.floor(temp), F.floor(temp).cast("string")).otherwise(temp.cast("string"))
    return F.concat(F.lit("''+"), F.coalesce(number, F.lit("NA")), F.lit("~degree~C"))


def paste(*parts: Column, sep: str = "") -> Column:
    """Join texts, printing a missing one as NA."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def coefficient_type(name: Column) -> Column:
    return F.when(name.contains("s"), F.lit("Seasonal")).otherwise(F.lit("Non-seasonal"))


def coefficient_base(name: Column) -> Column:
    """Coefficient name without its first ``s``."""
    return F.regexp_replace(name, "^([^s]*)s", "$1")
