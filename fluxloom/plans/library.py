"""Importing this module registers every model."""

from fluxloom.plans import additive, arima, climatology, driver_models, edm, ets, trees  # noqa: F401
from fluxloom.plans.common import MODELS, register_model  # noqa: F401
