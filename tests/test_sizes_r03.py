"""Work of a fit that grows with the number of series, counted, and results against a plain form."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fluxloom.operators import linalg, smallnets, treegrow
from fluxloom.operators.aggregates import DRIVER_VARIABLES
from fluxloom.operators.joins import full_calendar_join
from fluxloom.plans import driver_models
from fluxloom.plans.driver_models import complete_rows
from fluxloom.plans.library import MODELS
from tests.helpers import issues, month, monthly, rows, seasonal
from workload.views import Views

SF = "/root/testdata/sf0.001"


def net_stack(m: int, n: int = 40):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(m, n, 5))
    y = np.tanh(x[:, :, 0]) + 0.1 * rng.normal(size=(m, n))
    used = np.ones((m, n), bool)
    used[::2, -7:] = False
    return x, y, used


def test_nets_take_outputs_once_a_step(monkeypatch):
    x, y, used = net_stack(20)
    counted = {"tanh": 0, "steps": 0}
    tanh, solve = np.tanh, np.linalg.solve

    def counting_tanh(v, *rest, **named):
        counted["tanh"] += v.size
        return tanh(v, *rest, **named)

    def counting_solve(a, b):
        counted["steps"] += len(a)
        return solve(a, b)

    monkeypatch.setattr(np, "tanh", counting_tanh)
    monkeypatch.setattr(np.linalg, "solve", counting_solve)
    smallnets.fit_nets(x, y, used, 2, list(range(20)), smallnets.COMPARED)
    assert counted["steps"] > 100
    assert counted["tanh"] <= (counted["steps"] + 20) * 40 * 2


def test_a_net_does_not_depend_on_its_stack():
    many = 300
    x, y, used = net_stack(many)
    stack = smallnets.fit_nets(x, y, used, 2, list(range(many)))
    for i in (0, 1, 255, 256, 299):
        alone = smallnets.fit_nets(x[i : i + 1, used[i]], y[i : i + 1, used[i]], used[i : i + 1, used[i]], 2, [i])
        a, b = (smallnets.outputs(t[None], x[i][None], 2)[0][0] for t in (stack[i], alone[0]))
        assert np.abs(a - b).max() < 1e-6


def test_incomplete_rows_query_keeps_every_month(spark):
    months = {r.datetime.month for r in entry.queries()["drop_incomplete"](spark, SF).select("datetime").distinct().collect()}
    assert months == set(range(1, 13))


def test_a_missing_driver_drops_its_month(spark):
    """Of three months, the second lacks one driver in every member: only its row goes."""
    series = monthly(spark, {"a": [1.0, 2.0, 3.0]})
    cells = [
        (month(i), month(i), 1, "m", name, 1.0)
        for i in range(3)
        for name in DRIVER_VARIABLES
        if not (i == 1 and name == "WindSpeed_ms")
    ]
    drivers = spark.createDataFrame(cells, "reference_datetime date, datetime date, parameter int, model_id string, variable string, prediction double")
    drivers = drivers.withColumn("horizon", F.lit(1))
    kept = rows(complete_rows(series, drivers), "datetime")
    assert kept == [(month(0),), (month(2),)]


def test_calendar_query_uses_all_years(spark):
    """A month of a site has statistics if any year of the training series has that month."""
    train = Views(spark, SF).until_issue().where("observation IS NOT NULL")
    known = rows(train.select("site_id", F.month("datetime").alias("month")).distinct(), "site_id", "month")
    found = entry.queries()["full_calendar_join"](spark, SF).where("clim_mean IS NOT NULL")
    assert known and rows(found, "site_id", "month") == known


def test_calendar_join_adds_the_months_that_are_missing(spark):
    known = spark.createDataFrame([("a", 1, 5.0), ("a", 3, 7.0)], "site_id string, month int, clim_mean double")
    months = spark.createDataFrame([("a", k) for k in (1, 2, 3)], "site_id string, month int")
    found = full_calendar_join(known, months).orderBy("month").collect()
    assert [(r.month, r.clim_mean) for r in found] == [(1, 5.0), (2, None), (3, 7.0)]


def test_kernel_features_are_taken_in_batches(spark):
    """No cosine is left to Spark's array functions, and rows in a batch equal those functions."""
    views = Views(spark, SF)
    plan = MODELS["svm"](views.monthly, views.drivers, views.issues)._jdf.queryExecution().optimizedPlan().toString()
    assert "cos(" not in plan.lower()
    x = np.random.default_rng(5).normal(size=(20, 5))
    given = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>")
    for stage in driver_models.kernel_stages(16):
        given = given.withColumn("x", stage(F.col("x")))
    plain = np.array([r.x for r in given.orderBy("i").collect()])
    assert np.abs(driver_models.kernel_rows(16)(x) - plain).max() < 1e-12
    constant = driver_models.scaled_rows(np.ones((3, 1)), np.ones(1), np.zeros(1))
    assert (constant == 0).all()


def test_forest_sorts_each_level_once_and_equals_the_general_growth(monkeypatch):
    rng = np.random.default_rng(8)
    designs = [np.round(rng.normal(size=(n, 5)), 1) for n in (30, 41, 12)]
    targets = [d[:, 0] + 0.1 * rng.normal(size=len(d)) for d in designs]
    seeds, new = [3, 4, 5], [rng.normal(size=(6, 5))] * 3
    args = (designs, targets, new, seeds, 40, 1, 5, 60)
    calls = []
    general = treegrow.grow
    monkeypatch.setattr(treegrow, "grow", lambda *a: calls.append(1) or general(*a))
    fast = treegrow.forests(*args, importance=True)
    assert not calls
    monkeypatch.setattr(treegrow, "grow_by_one", lambda *a: general(*a[:7], 1, *a[7:]))
    for a, b in zip(fast, treegrow.forests(*args, importance=True), strict=True):
        for name in ("rows", "new", "rise", "spread"):
            assert np.array_equal(getattr(a, name), getattr(b, name), equal_nan=True)


def test_elastic_net_rows_are_not_repeated_for_folds(spark):
    """Series leave Spark packed: no row per repeat and no aggregate per fold; short series and dates have no fit."""
    series = monthly(spark, {"a": seasonal(30), "b": seasonal(9)})
    cells = [(month(i), month(i), 1, 1, name, float(np.sin(i * (k + 1)))) for i in range(30) for k, name in enumerate(DRIVER_VARIABLES)]
    drivers = spark.createDataFrame(cells, "reference_datetime date, datetime date, parameter int, horizon int, variable string, prediction double")
    fits = driver_models.elastic_net_fit(series, drivers, issues(spark, month(5), month(20), month(30)))
    assert "repeat" not in fits._jdf.queryExecution().optimizedPlan().toString().lower().replace("repartition", "")
    assert sorted((r.site_id, r.issue, r.n) for r in fits.collect()) == [("a", month(20), 20.0), ("a", month(30), 30.0)]
    z, numbers = np.random.default_rng(2).normal(size=(12, 4)), np.arange(24).reshape(12, 2) % 3
    parts = driver_models.fold_grams(z, numbers, 3)
    for repeat, fold, packed in parts:
        some = z[numbers[:, repeat - 1] == fold]
        assert np.allclose(linalg.unpack(packed), some.T @ some)
    assert len(parts) == len({(r, f) for r in (1, 2) for f in numbers[:, r - 1].tolist()})
