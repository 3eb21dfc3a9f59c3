"""Registry of queries and the helpers both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Off any exact decimal half, so that both engines round a last-bit difference the same way.
NUDGE = 0.5000123


def rounded(c: Column | str, digits: int = 4) -> Column:
    """Round by floor, in the same floating-point steps as ``sql_rounded``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * float(10**digits) + NUDGE).cast("double") / float(10**digits)


def sql_rounded(expression: str, digits: int = 4) -> str:
    scale = f"{10**digits}e0"
    return f"(floor(({expression})::DOUBLE * {scale} + 5.000123e-1) / {scale})"


def query(name: str, sql: str | None = None):
    """Register ``fn(views)``; ``sql`` is the same query over the given tables."""

    def wrap(fn):
        from workload.views import Views

        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
