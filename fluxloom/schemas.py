"""Declared schemas (as DDL) of the interchange tables, so that no reader has to infer one."""

TARGETS = (
    "project_id string, site_id string, datetime date, duration string, variable string, "
    "observation double, n bigint"
)
DRIVERS = (
    "horizon int, reference_datetime date, parameter int, datetime date, model_id string, "
    "variable string, prediction double"
)
FORECASTS = (
    "project_id string, model_id string, datetime date, reference_datetime date, duration string, "
    "site_id string, family string, parameter string, variable string, prediction double"
)
TREATMENTS = (
    "Plot string, Treat string, Temp double, Veg string, CO2 int, CO2Treat string, Transect int"
)
POREWATER = (
    "Year int, Month string, Day int, Plot string, Temperature int, CO2 int, Vegetation int, "
    "Depth int, SampleID string, umol_CH4 double, Type string"
)
FORECAST_VARIABLES = ("name string, target string, description string, duration string")
