"""Windows over one series, autocorrelation, and seasonal predictability from class counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.functions.values import ratio
from fluxloom.operators.reshape import unpivot_long


def group_aggregate_to_rows(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """Aggregates of a bounded group repeated on each of its rows."""
    w = Window.partitionBy(*keys)
    return df.withColumns({name: agg.over(w) for name, agg in aggregates.items()})


def global_aggregate_to_rows(df: DataFrame, aggregates: Mapping[str, Column]) -> DataFrame:
    """Aggregates of the whole table on each row: one scalar subquery, never an unpartitioned window."""
    one = df.agg(F.struct(*[agg.alias(name) for name, agg in aggregates.items()])).scalar()
    return df.withColumn("_all", one).select(*df.columns, *[F.col(f"_all.{n}").alias(n) for n in aggregates])


def lag_embedding(df: DataFrame, keys: Sequence[str], column: str, E: int, tau: int = -1, date="datetime") -> DataFrame:
    """Columns ``x0`` … ``x{E-1}``: the value now and ``tau`` steps apart."""
    w = Window.partitionBy(*keys).orderBy(date)
    return df.withColumns({f"x{i}": F.lag(column, -tau * i).over(w) for i in range(E)})


def argmax_by(df: DataFrame, keys: Sequence[str], value: str, metric: str) -> DataFrame:
    """The value with the highest metric per key; the smaller value wins a tie."""
    best = F.max_by(value, F.struct(F.col(metric), (-F.col(value)).alias("tie")))
    return df.where(F.col(metric).isNotNull()).groupBy(*keys).agg(best.alias(value), F.max(metric).alias(metric))


def acf(df: DataFrame, keys: Sequence[str], column: str, lags: Sequence[int], date="datetime") -> DataFrame:
    """Autocorrelation of a complete calendar with gaps.

    Lag covariance divides the sum over present pairs by pairs plus lag, so a long gap does not
    inflate it; lag zero divides by the number of present values.
    """
    rows = Window.partitionBy(*keys).orderBy(date)
    centred = df.withColumn("_c", F.col(column) - F.avg(column).over(Window.partitionBy(*keys)))
    centred = centred.withColumns({f"_p{k}": F.col("_c") * F.lag("_c", k).over(rows) for k in lags})
    c0 = F.avg(F.col("_c") * F.col("_c"))
    return centred.groupBy(*keys).agg(
        *[ratio(F.try_divide(F.sum(f"_p{k}"), F.count(f"_p{k}") + k), c0).alias(f"acf{k}") for k in lags]
    )


def series_stats(df: DataFrame, keys: Sequence[str], column="observation", date="datetime") -> DataFrame:
    """Location, spread, stability and autocorrelation of each series on its completed calendar."""
    by_row = Window.partitionBy(*keys).orderBy(date)
    x = df.withColumn("_c", F.col(column) - F.avg(column).over(Window.partitionBy(*keys)))
    x = x.withColumns({f"_p{k}": F.col("_c") * F.lag("_c", k).over(by_row) for k in (1, 12)})
    c0 = F.avg(F.col("_c") * F.col("_c"))
    correlation = lambda k: ratio(F.try_divide(F.sum(f"_p{k}"), F.count(f"_p{k}") + k), c0)
    q = F.percentile(column, [0.25, 0.5, 0.75])
    return x.groupBy(*keys).agg(
        F.avg(column).alias("mean"),
        q[1].alias("median"),
        F.stddev_samp(column).alias("sd"),
        (q[2] - q[0]).alias("IQR"),
        ratio(F.avg(column), F.stddev_samp(column)).alias("stability"),
        correlation(1).alias("acf1"),
        correlation(12).alias("acf12"),
        F.count("*").alias("n"),
    )


def equal_breaks(df: DataFrame, column: str, n: int = 11) -> DataFrame:
    """One row: ``n`` equally spaced class limits from the global minimum to the exact maximum."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / (n - 1)
    inner = F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: F.col("lo") + step * i)
    return ends.select(F.concat(inner, F.array("hi")).alias("breaks"))


def log_breaks(df: DataFrame, column: str, n: int = 11) -> DataFrame:
    """One row: ``n`` limits equally spaced in logarithm, from 1 to the range plus one."""
    ends = df.agg((F.max(column) - F.min(column) + 1).alias("top"))
    return ends.select(
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.exp(F.log("top") * i / (n - 1))).alias("breaks")
    )


def monthly_flow_classes(df: DataFrame, keys: Sequence[str], breaks: DataFrame, column="observation", date="datetime"):
    """Mean per month and year with its class: closed on the left, the last class on both sides."""
    means = df.groupBy(*keys, F.year(date).alias("year"), F.month(date).alias("month")).agg(F.avg(column).alias("Q"))
    limits = means.where(F.col("Q").isNotNull()).withColumn("_b", breaks.scalar())
    top = F.size("_b") - 1
    below = F.size(F.filter("_b", lambda b: b <= F.col("Q")))
    inside = (F.col("Q") >= F.col("_b")[0]) & (F.col("Q") <= F.get("_b", top))
    return limits.withColumn("class", F.when(inside, F.least(below, top))).drop("_b")


def colwell(df: DataFrame, keys: Sequence[str], breaks: DataFrame, n_states: int = 11, column="observation") -> DataFrame:
    """Predictability, constancy and contingency (Colwell 1974) from the month by class table.

    ``n_states`` is the number of limits, one more than the number of classes.
    """
    classes = monthly_flow_classes(df, keys, breaks, column).where(F.col("class").isNotNull())
    cells = classes.groupBy(*keys, "month", "class").agg(F.count("*").alias("n"))
    # All marginals of a key's table: at most 12 x (limits - 1) cells, so windows are bounded.
    by_key = Window.partitionBy(*keys)
    total = F.sum("n").over(by_key)
    by_month = F.sum("n").over(Window.partitionBy(*keys, "month"))
    by_class = F.sum("n").over(Window.partitionBy(*keys, "class"))
    cells = cells.withColumns({"_z": total, "_x": by_month, "_y": by_class})
    # A marginal's entropy spread over its cells: every cell adds its share n/z of log2(marginal/z).
    entropy = lambda c: -F.sum(F.col("n") / F.col("_z") * F.log2(F.col(c) / F.col("_z")))
    h = cells.groupBy(*keys).agg(entropy("_x").alias("_hx"), entropy("_y").alias("_hy"), entropy("n").alias("_hxy"))
    s = F.log2(F.lit(float(n_states)))
    hx, hy, hxy = F.col("_hx"), F.col("_hy"), F.col("_hxy")
    out = h.select(
        *keys,
        F.bround(1 - (hxy - hx) / s, 2).alias("P"),
        F.bround(1 - hy / s, 2).alias("C"),
        F.bround((hx + hy - hxy) / s, 2).alias("M"),
    )
    return out.withColumns({"CP": ratio(F.col("C"), F.col("P")), "MP": ratio(F.col("M"), F.col("P"))})


def colwell_long(indices: DataFrame) -> DataFrame:
    return unpivot_long(indices.drop("CP", "MP"), ["C", "M", "P"])
