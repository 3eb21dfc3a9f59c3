"""Skill metrics as aggregate expressions of an observation and a forecast column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rmse(obs: Column, fc: Column) -> Column:
    return F.sqrt(F.avg((obs - fc) * (obs - fc)))


def bias(obs: Column, fc: Column) -> Column:
    return F.avg(fc - obs)


def geometric_rmse(obs: Column, fc: Column) -> Column:
    """Geometric mean of absolute errors: zero after one exact hit, null after one missing value."""
    error = F.abs(fc - obs)
    mean = F.exp(F.avg(F.log(error)))
    return (
        F.when(F.count("*") > F.count(error), F.lit(None))
        .when(F.min(error) == 0, F.lit(0.0))
        .otherwise(mean)
    )


def geometric_mean(c: Column) -> Column:
    """Null once any value is missing or negative, zero once any value is zero."""
    return (
        F.when((F.count("*") > F.count(c)) | (F.min(c) < 0), F.lit(None))
        .when(F.min(c) == 0, F.lit(0.0))
        .otherwise(F.exp(F.avg(F.log(c))))
    )


def r2_one_to_one(obs: Column, fc: Column) -> Column:
    """Share of variance explained about the 1:1 line."""
    error = fc - obs
    return 1 - F.try_divide(F.sum(error * error), F.var_pop(obs) * F.count(obs))


def r2_regression(obs: Column, fc: Column) -> Column:
    return F.regr_r2(obs, fc)


def rmse_over_mean(obs: Column, fc: Column) -> Column:
    return F.try_divide(rmse(obs, fc), F.avg(obs))


def grmse_over_gmean(obs: Column, fc: Column) -> Column:
    return F.try_divide(geometric_rmse(obs, fc), geometric_mean(obs))
