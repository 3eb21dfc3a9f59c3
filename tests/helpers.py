"""Small series for brute-force checks."""

import datetime as dt

import numpy as np

MONTHLY = "project_id string, site_id string, datetime date, duration string, variable string, observation double"


def month(i: int, start=(2010, 1)) -> dt.date:
    k = start[0] * 12 + start[1] - 1 + i
    return dt.date(k // 12, k % 12 + 1, 1)


def monthly(spark, series: dict[str, list], start=(2010, 1)):
    """One row per present value; None leaves the month out."""
    rows = [
        ("p", site, month(i, start), "P1M", "flux", float(v))
        for site, values in series.items()
        for i, v in enumerate(values)
        if v is not None
    ]
    return spark.createDataFrame(rows, MONTHLY)


def issues(spark, *dates):
    return spark.createDataFrame([(d,) for d in dates], "issue date")


def seasonal(n: int, seed: int = 1, noise: float = 1.0) -> list[float]:
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return list(50 + 0.2 * t + 10 * np.sin(2 * np.pi * t / 12) + noise * rng.normal(size=n))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
