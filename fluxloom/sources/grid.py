"""Decoded gridded ensembles: dense arrays to rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_grid(df: DataFrame, dims: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Expand dense value arrays to one row per cell.

    ``dims`` name the coordinate arrays in storage order, the first varying fastest. ``values``
    name arrays as long as the product of the dimension sizes; they unfold together.
    """
    cells = df.select(
        *[c for c in df.columns if c not in values],
        F.posexplode(F.arrays_zip(*values)).alias("_pos", "_cell"),
    )
    stride = F.lit(1)
    coordinates = {}
    for dim in dims:
        size = F.size(dim)
        index = F.pmod(F.floor(F.col("_pos") / stride), size).cast("int")
        coordinates[dim] = F.get(F.col(dim), index)
        stride = stride * size
    return cells.select(
        *[c for c in df.columns if c not in values and c not in dims],
        *[coordinates[d].alias(d) for d in dims],
        *[F.col(f"_cell.{v}").alias(v) for v in values],
    )


def select_cell(df: DataFrame, at: Mapping[str, object]) -> DataFrame:
    """Rows of one grid cell; an equality filter that reaches the scan."""
    for column, value in at.items():
        df = df.where(F.col(column) == F.lit(value))
    return df
