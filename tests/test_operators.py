import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import aggregates as agg
from fluxloom.operators import calendar as cal
from fluxloom.operators import cleaning, joins, reshape, scoring, series
from fluxloom.operators import percentiles
from fluxloom.operators.percentiles import exact_percentiles
from tests.helpers import month, monthly, rows


def test_rule_without_plot_matches_all_plots(spark):
    raw = spark.createDataFrame(
        [("6/1/2020", "313", None, "5"), ("2020-06-01", "321", "Dark", "6"), ("2020-06-02", "313", "Light", "7"),
         ("2020-06-03", "313", "Dark", "8"), ("2020-06-03", "321", "Dark", "NA")],
        "Date string, Plot string, Light string, flux string",
    )
    rules = spark.createDataFrame(
        [(dt.date(2020, 6, 1), None), (dt.date(2020, 6, 1), "313"), (dt.date(2020, 6, 3), "321")], "date date, plot string"
    )
    clean = cleaning.clean_flux(raw, rules)
    assert sorted(clean.collect(), key=str) == sorted(
        [(dt.date(2020, 6, 1), "313", None), (dt.date(2020, 6, 1), "321", None), (dt.date(2020, 6, 3), "313", 8.0),
         (dt.date(2020, 6, 3), "321", None)], key=str
    )


def test_null_model_is_kept(spark):
    df = spark.createDataFrame([("ets",), ("lasso",), (None,)], "model_id string")
    assert {r.model_id for r in cleaning.exclude_models(df).collect()} == {"ets", None}


@pytest.mark.parametrize("spread", ["ties", "heavy", "uniform"])
def test_bracketed_percentiles_equal_numpy_under_skew(spark, spread):
    """One key holds nearly all rows."""
    rng = np.random.default_rng(3)
    draw = {
        "ties": lambda n: rng.integers(0, 5, n).astype(float),
        "heavy": lambda n: rng.pareto(0.7, n),
        "uniform": lambda n: rng.uniform(0, 1, n),
    }[spread]
    data = {"hot": draw(60_000), "cold": draw(7), "one": draw(1)}
    table = [(k, float(v)) for k, xs in data.items() for v in xs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(table, "k string, v double").repartition(6)
    probs = {"a": 0.25, "b": 0.5, "c": 0.9}
    large = {"accuracy": 200}
    for options in ({}, {**large, "hot_rows": 5000}, {**large, "hot_rows": 100}, {**large, "hot_rows": 0}):
        got = {r.k: r for r in exact_percentiles(df, ["k"], "v", probs, [F.count("*").alias("n")], **options).collect()}
        assert got["none"].a is None and got["hot"].n == 60_001
        for k, xs in data.items():
            for name, p in probs.items():
                assert got[k][name] == pytest.approx(np.quantile(xs, p), rel=1e-12)


def test_brackets_are_narrowed_until_a_task_can_take_them(spark, monkeypatch):
    """Values over the whole range of doubles, and many ties, in two groups (one of a null key)."""
    sizes, narrowed = [], percentiles._narrowed

    def watched(df, brackets, *rest):
        out = narrowed(df, brackets, *rest)
        sizes.append(out is not None)
        return out

    monkeypatch.setattr(percentiles, "_narrowed", watched)
    rng = np.random.default_rng(5)
    data = {None: rng.choice([-1.0, 1.0], 9000) * 10.0 ** rng.uniform(-300, 308, 9000), "b": np.repeat(rng.normal(size=300), 30)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs], "k string, v double").repartition(5)
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.75}, hot_rows=40, accuracy=40).collect()}
    for k, xs in data.items():
        for name, p in {"a": 0.1, "b": 0.5, "c": 0.75}.items():
            assert got[k][name] == pytest.approx(np.quantile(xs, p), rel=1e-12)
    assert sum(sizes) >= 2 and not sizes[-1]


def test_months_complete_within_and_across(spark):
    df = monthly(spark, {"a": [1, None, None, 4], "b": [None, 2, 3]})
    site = cal.complete_site_months(df, ["site_id"])
    assert rows(site.where("site_id = 'a'"), "datetime", "observation")[1:3] == [(month(1), None), (month(2), None)]
    assert site.where("site_id = 'b'").count() == 2
    assert cal.complete_global_months(df, ["site_id"]).count() == 8


def test_fixed_grid_keeps_rows_outside(spark):
    df = monthly(spark, {"a": [1, None, 3], "late": [None] * 14 + [9]}, start=(2010, 11))
    full = cal.complete_fixed_months(df, ["site_id"], 2011, 2011)
    a = rows(full.where("site_id = 'a'"), "datetime")
    assert a[0] == (dt.date(2010, 11, 1),) and len(a) == 13
    late = rows(full.where("site_id = 'late'"), "datetime")
    assert late[-1] == (dt.date(2012, 1, 1),) and len(late) == 13


def test_interpolation_restores_a_ramp_and_extends_ends(spark):
    gaps = cal.complete_fixed_months(monthly(spark, {"a": [None, 1, None, None, 4, None, 6]}), ["site_id"], 2010, 2010)
    filled = [v for _, v in rows(cal.interpolate_linear(gaps, ["site_id"], "datetime", "observation"), "datetime", "observation")]
    assert filled == pytest.approx([1, 1, 2, 3, 4, 5, 6, 6, 6, 6, 6, 6])


def test_month_mean_fill_uses_the_same_month_only(spark):
    values = [float(i) for i in range(36)]
    values[13] = None
    full = cal.complete_site_months(monthly(spark, {"a": values}), ["site_id"])
    filled = dict(rows(cal.fill_month_mean(full, ["site_id"]), "datetime", "observation"))
    assert filled[month(13)] == (1 + 25) / 2


def test_month_starts_by_day(spark):
    df = monthly(spark, {"a": [1, 2]})
    out = cal.future_days_month_starts(df, ["site_id"], F.lit(dt.date(2010, 3, 15)), 2)
    assert rows(out, "datetime") == [(dt.date(2010, 3, 1),), (dt.date(2010, 4, 1),), (dt.date(2010, 5, 1),)]


def test_acf_of_alternating_series_and_against_definition(spark):
    xs = [3.0, 1.0, None, 4.0, 1.0, 5.0, None, 2.0, 6.0, 5.0, 3.0, 5.0]
    df = cal.complete_site_months(monthly(spark, {"a": xs, "alt": [1, -1] * 6}), ["site_id"])
    got = {r.site_id: r for r in series.acf(df, ["site_id"], "observation", [1, 2]).collect()}
    assert got["alt"].acf1 < -0.8
    x = np.array([np.nan if v is None else v for v in xs])
    c = x - np.nanmean(x)
    for k in (1, 2):
        pairs = c[:-k] * c[k:]
        expected = np.nansum(pairs) / (np.sum(~np.isnan(pairs)) + k) / np.nanmean(c * c)
        assert got["a"][f"acf{k}"] == pytest.approx(expected)


def test_colwell_extremes(spark):
    breaks = spark.createDataFrame([([float(b) for b in range(0, 121, 12)],)], "breaks array<double>")
    same = [30.0] * 36
    repeating = [10.0 * (i % 12) for i in range(36)]
    df = monthly(spark, {"same": same, "repeat": repeating})
    got = {r.site_id: r for r in series.colwell(df, ["site_id"], breaks).collect()}
    assert (got["same"].C, got["same"].P, got["same"].M, got["same"].MP) == (1.0, 1.0, 0.0, 0.0)
    assert got["repeat"].P == 1.0
    assert got["repeat"].C + got["repeat"].M == pytest.approx(1.0, abs=0.011)


def test_colwell_against_entropies(spark):
    rng = random.Random(5)
    values = [rng.uniform(0, 100) for _ in range(60)]
    df = monthly(spark, {"a": values})
    got = series.colwell(df, ["site_id"], series.equal_breaks(df, "observation")).first()
    lo, hi = min(values), max(values)
    table = np.zeros((10, 12))
    for i, v in enumerate(values):
        table[min(int((v - lo) / (hi - lo) * 10), 9), i % 12] += 1
    h = lambda p: -sum(x * math.log2(x) for x in np.ravel(p) if x > 0)
    z = table.sum()
    hx, hy, hxy = h(table.sum(0) / z), h(table.sum(1) / z), h(table / z)
    s = math.log2(11)
    assert got.P == pytest.approx(1 - (hxy - hx) / s, abs=0.006)
    assert got.C == pytest.approx(1 - hy / s, abs=0.006)
    assert got.M == pytest.approx((hx + hy - hxy) / s, abs=0.006)


def test_crps_of_an_ensemble_against_all_pairs(spark):
    xs, y = [3.0, 1.0, 7.0, 4.0], 2.5
    df = spark.createDataFrame([("f", x, y) for x in xs], "k string, prediction double, observation double")
    brute = np.mean(np.abs(np.array(xs) - y)) - np.mean(np.abs(np.subtract.outer(xs, xs))) / 2
    assert scoring.crps_ensemble(df, ["k"]).first().crps == pytest.approx(brute)


def test_argmax_prefers_the_smaller_on_a_tie(spark):
    df = spark.createDataFrame([("a", 3, 0.5), ("a", 2, 0.5), ("a", 1, 0.4), ("a", 4, None)], "k string, E int, rho double")
    assert series.argmax_by(df, ["k"], "E", "rho").first().E == 2


def test_stack_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "y int")
    assert {tuple(r) for r in reshape.stack([a, b]).select("x", "y").collect()} == {(1, 2), (None, 3)}


def test_latest_issue_before_any_reference_is_empty(spark):
    df = spark.createDataFrame([(dt.date(2020, 2, 1), 1), (dt.date(2020, 4, 1), 2)], "reference_datetime date, v int")
    wanted = spark.createDataFrame([(dt.date(2020, 1, 1),), (dt.date(2020, 3, 1),), (dt.date(2020, 4, 1),)], "issue date")
    assert rows(joins.latest_issue(df, wanted), "issue", "v") == [(dt.date(2020, 3, 1), 1), (dt.date(2020, 4, 1), 2)]


def test_replicate_mean_is_unweighted(spark):
    df = monthly(spark, {"311": [1, 3], "321": [5]})
    assert rows(agg.rep_mean_targets(df), "site_id", "datetime", "observation") == [
        ("31", month(0), 3.0), ("31", month(1), 3.0)
    ]


def test_row_order_and_partitions_do_not_matter(spark):
    df = monthly(spark, {"a": [1, None, 5, 2], "b": [4, None, None, 1, 9]})
    once = rows(cal.filled_series(df, ["site_id"]), "site_id", "datetime", "observation")
    again = rows(cal.filled_series(df.orderBy(F.rand(1)).repartition(7), ["site_id"]), "site_id", "datetime", "observation")
    assert once == again
