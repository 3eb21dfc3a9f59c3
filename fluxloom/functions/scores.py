"""Proper scores of a normal forecast as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26, absolute error at most 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return (1 + erf(z / math.sqrt(2))) / 2


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def crps_normal(mu: Column, sigma: Column, y: Column) -> Column:
    """Continuous ranked probability score; absolute error when the forecast has no spread."""
    z = F.try_divide(y - mu, sigma)
    score = sigma * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))
    return F.when(sigma > 0, score).when(sigma == 0, F.abs(y - mu))


def log_score_normal(mu: Column, sigma: Column, y: Column) -> Column:
    """Negative log density; null when the forecast has no spread."""
    z = F.try_divide(y - mu, sigma)
    return F.when(sigma > 0, F.log(2 * math.pi * sigma * sigma) / 2 + z * z / 2)
