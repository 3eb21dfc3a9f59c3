"""Projection, stacking and long/wide reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(
    df: DataFrame,
    keep: Sequence[str] | None = None,
    drop: Sequence[str] = (),
    rename: Mapping[str, str] | None = None,
    tags: Mapping[str, object] | None = None,
) -> DataFrame:
    """Select, drop, rename and add constant columns in one projection."""
    if keep is not None:
        df = df.select(*keep)
    df = df.drop(*drop).withColumnsRenamed(dict(rename or {}))
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in (tags or {}).items()})


def stack(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def unpivot_long(df: DataFrame, columns: Sequence[str], name="name", value="value") -> DataFrame:
    """Wide to long: one output row per input row and listed column."""
    ids = [c for c in df.columns if c not in columns]
    return df.unpivot(ids, list(columns), name, value)


def pivot_wide(df: DataFrame, keys, name: str, value: str, names: Sequence[str], how=F.first) -> DataFrame:
    """Long to wide by conditional aggregates: one shuffle, no job to discover the names."""
    cells = [how(F.when(F.col(name) == n, F.col(value)), ignorenulls=True) if how is F.first
             else how(F.when(F.col(name) == n, F.col(value))) for n in names]
    return df.groupBy(*keys).agg(*[c.alias(n) for c, n in zip(cells, names)])


def transpose_compare(df: DataFrame, by: str, stats: Sequence[str], a: object, b: object) -> DataFrame:
    """Statistics as rows, two treatments as columns, with their ratio to one decimal."""
    long = unpivot_long(df.select(by, *stats), stats)
    pick = lambda level: F.max(F.when(F.col(by) == level, F.col("value")))
    wide = long.groupBy("name").agg(pick(a).alias("low"), pick(b).alias("high"))
    return wide.withColumn("dif", F.bround(F.try_divide("high", "low"), 1))


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def sort_by(df: DataFrame, *columns: str) -> DataFrame:
    """Total order for output; operators order inside keys by window instead."""
    return df.orderBy(*columns)


def nest_rows(df: DataFrame, keys: Sequence[str], order="datetime", value="observation") -> DataFrame:
    """One row per key holding its series as a date-sorted array; a key is a bounded series."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("series"))
