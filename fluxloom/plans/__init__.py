"""Forecast models and the runs that combine them. Issue dates are a column, not a loop."""
