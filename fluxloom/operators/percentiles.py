"""Exact grouped percentiles (linear interpolation between order statistics, type 7).

The built-in ``percentile`` is exact but keeps every distinct value of a group in one task, which is right
while groups are small. So the rows are written once and counted per group, and each group goes its way by
its own number of rows. Groups beyond ``hot_rows`` are taken apart: a bounded sketch brackets each wanted
rank, further sketches narrow a bracket that still holds too many, rows outside the brackets collapse to a
count per bracket edge before the shuffle, and the built-in runs on what is left. All ways give the same values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.session import staged

#: Rows of one group up to which the built-in is used, and of one bracket that a task takes whole.
HOT_ROWS = 1_000_000
#: Rank error of the bracketing sketch is at most rows / ACCURACY.
ACCURACY = 10_000
#: Parts that a bracket is cut into when it is narrowed.
MARKS = 256


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    probs: Mapping[str, float],
    extra: Sequence[Column] = (),
    hot_rows: int = HOT_ROWS,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per key with a column per named percentile, plus the ``extra`` aggregates.

    ``extra`` may use the keys and ``column`` only.
    """
    keys, names, ps = list(keys), list(probs), [float(p) for p in probs.values()]
    plain = lambda rows: rows.groupBy(*keys).agg(*extra, F.percentile(column, ps).alias("_q"))
    rows = staged(df.select(*keys, column), "percentiles")
    counts = rows.groupBy(*keys).agg(F.count(column).alias("_n")).where(F.col("_n") > hot_rows)
    # At most rows / hot_rows groups.
    hot = staged(counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys]), "hot-keys")
    if hot.isEmpty():
        out = plain(rows)
    else:
        cold = plain(rows.join(hot, _same_key(keys), "left_anti"))
        taken_apart = _bracketed(rows.join(hot, _same_key(keys), "left_semi"), keys, column, ps, list(extra), hot_rows, accuracy)
        out = cold.unionByName(taken_apart)
    taken = [F.col("_q")[i].alias(n) for i, n in enumerate(names)]
    return out.select(*[c for c in out.columns if c != "_q"], *taken)


def _same_key(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])


def _bracketed(df, keys, column, ps, extra, hot_rows, accuracy):
    v = F.col(column)
    order = sorted(set(ps))
    margin = 2.0 / accuracy
    marks = [min(max(p + d, 0.0), 1.0) for p in order for d in (-margin, margin)]
    # One row per hot group: staged, so that the join below knows it is small and broadcasts it.
    brackets = df.groupBy(*keys).agg(
        F.percentile_approx(column, marks, accuracy).alias("_marks"),
        F.count(v).alias("_n"),
        F.min(v).alias("_min"),
        F.max(v).alias("_max"),
        *extra,
    )
    brackets = staged(brackets.withColumn("_g", F.monotonically_increasing_id()), "brackets")
    # Below a few times the accuracy the margin is less than one rank: keep such groups whole.
    whole = F.col("_n") <= 4 * accuracy
    edges = F.when(whole, F.array(*[x for _ in order for x in ("_min", "_max")])).otherwise(
        F.col("_marks").cast("array<double>")
    )
    renamed = brackets.select(*[F.col(k).alias(f"_k_{k}") for k in keys], edges.alias("_edges"), "_g", "_n", "_min")
    on = _same_key(keys)
    while True:
        narrower = _narrowed(df, renamed, keys, v, order, max(hot_rows, 4 * accuracy), accuracy)
        if narrower is None:
            break
        renamed = narrower
    joined = df.select(*keys, v.cast("double").alias("_v")).where(v.isNotNull()).join(renamed, on)
    # A value inside a bracket stays; one between brackets becomes the edge below it.
    snapped = F.col("_min")
    for i in range(len(order)):
        lo, hi = F.col("_edges")[2 * i], F.col("_edges")[2 * i + 1]
        snapped = F.when(F.col("_v") > hi, hi).when(F.col("_v") >= lo, F.col("_v")).otherwise(snapped)
    counts = joined.select(*keys, snapped.alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    values = counts.groupBy(*keys).agg(F.percentile("_v", ps, F.col("_c")).alias("_q"))
    values = values.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_q")
    return brackets.drop("_marks", "_g", "_n", "_min", "_max").join(values, on, "left").drop(*[f"_k_{k}" for k in keys])


def _narrowed(df, brackets, keys, v, order, hot_rows, accuracy):
    """Brackets (``_edges`` of each hot group ``_g``) narrowed once; None where each holds few enough values.

    The values strictly inside a wide bracket are cut into parts of about equal counts by a bounded sketch, and
    the parts that may hold the wanted ranks stay. So whatever the values are, what is inside shrinks to some
    parts of MARKS each time; ties at the edges need no room.
    """
    parts = max(2, min(MARKS, accuracy // 4))  # a part is several times the sketch's error
    values = df.select(*keys, v.cast("double").alias("_v")).where(v.isNotNull()).join(brackets, _same_key(keys))
    edge = lambda i: F.get("_edges", F.lit(i))
    intervals = F.array(*[F.struct(F.lit(i).alias("i"), edge(2 * i).alias("lo"), edge(2 * i + 1).alias("hi")) for i in range(len(order))])
    held = values.select("_g", "_n", "_v", F.explode(intervals).alias("b")).select("_g", "_n", "_v", "b.*")
    between = (F.col("_v") > F.col("lo")) & (F.col("_v") < F.col("hi"))
    inside = staged(
        held.groupBy("_g", "_n", "i", "lo", "hi").agg(F.count_if(F.col("_v") <= F.col("lo")).alias("below"), F.count_if(between).alias("rows")), "inside"
    )
    wide = F.col("rows") > hot_rows
    if not inside.where(wide).limit(1).count():
        return None
    met = held.join(inside.where(wide).select("_g", "i"), ["_g", "i"]).where(between)
    marks = met.groupBy("_g", "i").agg(F.percentile_approx("_v", [k / parts for k in range(parts + 1)], accuracy).alias("marks"))
    place = F.get(F.array(*[F.lit(p) for p in order]), F.col("i")) * (F.col("_n") - 1)
    first, last = F.floor(place) - F.col("below"), F.ceil(place) - F.col("below")
    # One part further on both sides than the ranks ask for.
    lower = (F.floor(first * parts / F.col("rows")) - 1).cast("int")
    upper = (F.ceil((last + 1) * parts / F.col("rows")) + 1).cast("int")
    lo = F.when((first >= 0) & (lower >= 0), F.coalesce(F.get("marks", lower), F.col("lo"))).otherwise(F.col("lo"))
    hi = F.when((last < F.col("rows")) & (upper <= parts), F.coalesce(F.get("marks", upper), F.col("hi"))).otherwise(F.col("hi"))
    # A wanted value among the ties of an edge needs that edge only.
    lo, hi = F.when(first >= F.col("rows"), F.col("hi")).otherwise(lo), F.when(last < 0, F.col("lo")).otherwise(hi)
    kept = inside.join(marks, ["_g", "i"], "left").select("_g", F.struct("i", lo.alias("lo"), hi.alias("hi")).alias("e"))
    edges = kept.groupBy("_g").agg(F.flatten(F.transform(F.sort_array(F.collect_list("e")), lambda e: F.array(e.lo, e.hi))).alias("_edges"))
    return staged(brackets.drop("_edges").join(edges, "_g"), "brackets")
