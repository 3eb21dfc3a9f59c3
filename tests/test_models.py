import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import linalg, smallnets
from fluxloom.plans import additive, arima, driver_models, edm, ets
from fluxloom.plans.climatology import fc_climatology
from fluxloom.plans.common import FITS, SERIES, issue_array, series_arrays, training_series
from fluxloom.plans.library import MODELS
from tests.helpers import issues, month, monthly, rows, seasonal

N = 72
ISSUE = month(N)


@pytest.fixture(scope="module")
def data(spark):
    gappy = seasonal(N, 2)
    for i in (5, 6, 30):
        gappy[i] = None
    return monthly(spark, {"a": seasonal(N, 1), "b": gappy}).cache()


def filled(data, site):
    return np.array([v for v in rows_of(data, site)])


def rows_of(data, site):
    from fluxloom.operators.calendar import filled_series

    return [v for _, v in rows(filled_series(data.where(F.col("site_id") == site), list(SERIES)), "datetime", "observation")]


def test_climatology_uses_the_issue_month_and_trims(spark):
    values = [float(i % 12) for i in range(24)] + [100.0]
    df = monthly(spark, {"a": values})
    out = rows(fc_climatology(df, None, issues(spark, month(24))), "datetime", "mu", "sigma")
    # The issue month is in training, so the forecast starts a month later.
    assert [d for d, _, _ in out] == [month(25 + k) for k in range(6)]
    assert [mu for _, mu, _ in out] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    strict = rows(fc_climatology(df, None, issues(spark, month(24)), inclusive=False), "datetime", "mu")
    assert strict[0] == (month(24), 0.0)


def test_climatology_issue_inside_a_month_drops_that_month(spark):
    df = monthly(spark, {"a": [float(i % 12) for i in range(24)]})
    late = month(24).replace(day=15)
    assert rows(fc_climatology(df, None, issues(spark, late)), "datetime")[0] == (month(25),)


def test_climatology_skips_short_and_spreadless_series(spark):
    df = monthly(spark, {"few": [1, 2, 3, 4], "year": list(range(12)), "ok": list(range(24))})
    out = fc_climatology(df, None, issues(spark, month(30)))
    assert {r.site_id for r in out.collect()} == {"ok"}


def test_many_issue_dates_equal_single_ones(spark, data):
    dates = [month(N - 8), month(N - 3), ISSUE]
    for model in ("climatology", "ets", "prophet"):
        many = rows(MODELS[model](data, None, issues(spark, *dates)), "site_id", "reference_datetime", "datetime", "mu", "sigma")
        single = sorted(
            row for d in dates
            for row in rows(MODELS[model](data, None, issues(spark, d)), "site_id", "reference_datetime", "datetime", "mu", "sigma")
        )
        assert [r[:3] for r in many] == [r[:3] for r in single]
        assert np.allclose([r[3:] for r in many], [r[3:] for r in single])


def ets_fold(y, a, b, phi, g):
    m1, m2 = np.mean(y[:12]), np.mean(y[12:24])
    level, trend = m1, 0.0
    if phi:
        trend = (m2 - m1) / 12
        level = m1 - 6.5 * trend
    season = list((y[:12] - m1 + y[12:24] - m2) / 2) if g else [0.0] * 12
    sse = 0.0
    for v in y:
        base = level + phi * trend
        e = v - base - season[0]
        level, trend = base + a * e, phi * trend + b * e
        season = season[1:] + [season[0] + g * e]
        sse += e * e
    return level, trend, season, sse


def test_ets_picks_the_best_grid_point_and_its_states(spark, data):
    best = ets.ets_states(series_arrays(training_series(data, issues(spark, ISSUE))))
    for row in best.collect():
        y = filled(data, row.site_id)
        n = len(y)
        tried = []
        for a, b, phi, g, k in ets.parameter_grid():
            level, trend, season, sse = ets_fold(y, a, b, phi, g)
            kk = k + 1
            tried.append((n * np.log(sse) + 2 * kk + 2 * kk * (kk + 1) / (n - kk - 1), level, season))
        winner = min(tried, key=lambda r: r[0])
        assert row.aicc == pytest.approx(winner[0])
        assert row.end.l == pytest.approx(winner[1])
        assert row.end.s == pytest.approx(winner[2])


def test_simplex_against_brute_force(spark, data):
    got = {(r.site_id, r.E): r.rho for r in edm.simplex_skill(series_arrays(training_series(data, issues(spark, ISSUE)))).collect()}
    y = filled(data, "a")
    n, lib = len(y), int(np.round(len(y) * 0.8))
    for e in (1, 3, 12):
        preds, obs = [], []
        for t in range(max(lib + 1, e), n - 6 + 1):
            points = [s for s in range(e, lib - 6 + 1)]
            vector = lambda i: y[i - e : i]
            near = sorted((np.linalg.norm(vector(t) - vector(s)), s) for s in points)[: e + 1]
            w = np.maximum(np.exp(-np.array([d for d, _ in near]) / near[0][0]), 1e-6)
            preds.append(np.sum(w * [y[s + 5] for _, s in near]) / w.sum())
            obs.append(y[t + 5])
        assert got[("a", e)] == pytest.approx(np.corrcoef(preds, obs)[0, 1])


def test_smap_iterates_the_least_squares_map(spark, data):
    fit = edm.smap_fit(data, issues(spark, ISSUE)).where("site_id = 'b'").first()
    y, e = filled(data, "b"), fit.E
    x = np.array([[1.0, *y[t - e + 1 : t + 1][::-1]] for t in range(e - 1, len(y) - 1)])
    coef, *_ = np.linalg.lstsq(x, y[e:], rcond=None)
    assert fit.coef == pytest.approx(coef, rel=1e-5, abs=1e-6)
    state = list(y[::-1][:e])
    path = []
    for _ in range(7):
        state = [float(coef @ [1.0, *state[:e]]), *state]
        path.append(state[0])
    out = rows(MODELS["rEDM"](data.where("site_id = 'b'"), None, issues(spark, ISSUE)), "datetime", "mu")
    assert [v for _, v in out] == pytest.approx(path, rel=1e-5)


def test_arima_forecast_recursion(spark, data):
    fit = arima.arima_fits(data, issues(spark, ISSUE)).where("site_id = 'a'").first()
    c = dict(zip(arima.TERMS, fit.coef))
    w, e, y = list(fit.w), list(fit.e), list(fit.y)
    assert y[0] == pytest.approx(filled(data, "a")[-1])
    path = []
    for _ in range(7):
        nxt = c["drift"] + sum(c[f"ar{i}"] * w[i - 1] for i in range(1, 6)) + c["sar1"] * w[11]
        nxt += c["ma1"] * e[0] + c["ma2"] * e[1] + c["sma1"] * e[11]
        y.insert(0, y[11] + nxt)
        w.insert(0, nxt)
        e.insert(0, 0.0)
        path.append(y[0])
    out = rows(MODELS["auto.arima"](data.where("site_id = 'a'"), None, issues(spark, ISSUE)), "datetime", "mu", "sigma")
    assert [r[1] for r in out] == pytest.approx(path)
    assert out[0][2] == pytest.approx(0.994457883209753 * np.sqrt(fit.noise))
    assert all(later[2] >= earlier[2] - 1e-9 for earlier, later in zip(out, out[1:]))


def test_arima_on_a_short_series_is_seasonal_naive(spark):
    values = [float(10 + i % 12) for i in range(14)]
    out = rows(MODELS["auto.arima"](monthly(spark, {"a": values}), None, issues(spark, month(14))), "mu")
    assert [v for v, in out] == sorted(values[2:9])


def test_additive_matches_numpy_ridge(spark, data):
    samples = [
        (r.x, r.observation)
        for r in additive.additive_samples(data, issues(spark, ISSUE)).where("site_id = 'a'").orderBy("datetime").collect()
    ]
    x = np.array([[1.0, *s[0]] for s in samples])
    y = np.array([s[1] for s in samples])
    assert x.shape == (N, 47)
    penalty = np.eye(47)
    penalty[0, 0] = 0
    expected = np.linalg.solve(x.T @ x + penalty, x.T @ y)
    fit = additive.additive_fit(data, issues(spark, ISSUE)).where("site_id = 'a'").first()
    assert x @ np.array(fit.coef) == pytest.approx(x @ expected, abs=1e-4)


def test_gram_wide_and_tall_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(size=(40, 3))
    table = [("hot" if i < 35 else "cold", month(i), *map(float, v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(table, "k string, datetime date, a double, b double, y double").repartition(5)
    cut = month(20)
    for x in ([F.col("a"), F.col("b")], F.array("a", "b")):
        whole = linalg.gram(df, ["k"], x, F.col("y")).where("k = 'hot'").first().gram
        z = np.column_stack([np.ones(35), values[:35]])
        assert linalg.unpack(whole) == pytest.approx(z.T @ z)
        before = linalg.gram(df, ["k"], x, F.col("y"), issue_array(issues(spark, cut))).where("k = 'hot'").first()
        assert before.issue == cut and linalg.unpack(before.gram) == pytest.approx(z[:20].T @ z[:20])


def test_elastic_net_satisfies_optimality():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 4)) @ np.diag([1, 5, 0.1, 2]) + 3
    y = x @ [1.0, 0.0, 4.0, -0.5] + rng.normal(size=80)
    z = np.column_stack([np.ones(80), x, y])
    lam, alpha = 0.05, 0.6
    coef = linalg.elastic_net_path((z.T @ z)[None], np.array([lam]), np.array([alpha]), sweeps=500)[0, 0]
    xs, ys = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
    b = coef[1:] * x.std(0) / y.std()
    gradient = xs.T @ (ys - xs @ b) / 80 - lam * (1 - alpha) * b
    for j in range(4):
        if abs(b[j]) > 1e-9:
            assert gradient[j] == pytest.approx(lam * alpha * np.sign(b[j]), abs=1e-6)
        else:
            assert abs(gradient[j]) <= lam * alpha + 1e-6
    assert np.mean(y - coef[0] - x @ coef[1:]) == pytest.approx(0, abs=1e-8)


def test_folds_do_not_depend_on_partitioning(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    once = rows(driver_models.cv_folds(df, ["k"], 5, 2), "k", "repeat", "fold")
    again = rows(driver_models.cv_folds(df.repartition(9), ["k"], 5, 2), "k", "repeat", "fold")
    assert once == again and {f for *_, f in once} == {0, 1, 2, 3, 4}


def test_fourier_features_approach_the_radial_kernel(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(12, 31))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "i int, x array<double>")
    z = np.array([r.z for r in df.select("i", driver_models.fourier_features(F.col("x"), 600).alias("z")).orderBy("i").collect()])
    exact = np.exp(-((points[:, None] - points[None]) ** 2).sum(axis=2) / 31)
    assert np.abs(z @ z.T - exact).max() < 0.2


def test_elastic_nets_of_a_batch_equal_single_ones():
    """Penalties differ per fit; each fit's candidates, folds and coefficients do not depend on its batch."""
    rng = np.random.default_rng(6)
    fits = []
    for k in range(4):
        x = rng.normal(size=(50, 5)) * [1, 10, 0.1, 3, 1] + 2
        y = x @ [1.0, 0.0, 4.0, -0.5, 0.0] * (k + 1) + rng.normal(size=50)
        z = np.column_stack([np.ones(50), x, y])
        fold = rng.integers(0, 5, 50)
        pack = lambda m: m[np.triu_indices(7)]
        fits.append([(1, f, pack(z[fold == f].T @ z[fold == f])) for f in range(5)])
    together = driver_models.choose_elastic_nets(fits, [1, 2, 3, 4])
    for k, fit in enumerate(fits):
        alone = driver_models.choose_elastic_nets([fit], [k + 1])[0]
        assert together[k][1] == pytest.approx(alone[1], abs=1e-7) and together[k][4:6] == pytest.approx(alone[4:6])
        assert together[k][6] < 1e-7
        whole = linalg.unpack(np.stack([p[2] for p in fit])).sum(axis=0)
        alphas, shares = driver_models.drawn_penalties([k + 1], driver_models.CANDIDATES)
        errors = []
        for alpha, lam in zip(alphas[0], shares[0] * linalg.largest_penalty(whole[None])[0], strict=True):
            error = 0.0
            for p in fit:
                out = linalg.unpack(p[2])
                b = linalg.elastic_net_path((whole - out)[None], np.array([lam]), np.array([alpha]))[0, 0]
                v = np.append(b, -1.0)
                error += v @ out @ v
            errors.append(error)
        assert together[k][4] == pytest.approx(alphas[0][int(np.argmin(errors))])


def test_nets_recover_a_curve_and_do_not_depend_on_their_batch():
    rng = np.random.default_rng(0)
    xs = [rng.normal(size=(int(k), 5)) for k in rng.integers(30, 60, 4)]
    ys = [1e5 + 5000 * np.tanh(x[:, 0]) + 2000 * x[:, 1] + 300 * rng.normal(size=len(x)) for x in xs]
    nets = smallnets.chosen_nets(xs, ys, [1, 2, 3, 4], (1, 2, 3), 5, 2)
    for (units, theta, middle, half), x, y in zip(nets, xs, ys, strict=True):
        new = rng.normal(size=(200, 5))
        truth = 1e5 + 5000 * np.tanh(new[:, 0]) + 2000 * new[:, 1]
        predicted = middle + half * smallnets.outputs(theta[None], new[None], units)[0][0]
        assert np.sqrt(np.mean((predicted - truth) ** 2)) < 0.4 * truth.std()
    alone = smallnets.chosen_nets(xs[2:3], ys[2:3], [3], (1, 2, 3), 5, 2)[0]
    assert alone[0] == nets[2][0] and alone[1] == pytest.approx(nets[2][1], rel=1e-6, abs=1e-9)
    flat = smallnets.chosen_nets([np.zeros((12, 5))], [np.full(12, 7.0)], [5], (1, 2), 5, 1)[0]
    assert flat[2] + flat[3] * smallnets.outputs(flat[1][None], np.zeros((1, 1, 5)), flat[0])[0][0, 0] == pytest.approx(7.0, abs=0.1)


def test_slopes_of_a_net():
    rng = np.random.default_rng(1)
    theta, x = rng.normal(size=(3, 14)), rng.normal(size=(3, 6, 5))
    _, slopes = smallnets.outputs(theta, x, 2)
    for k in range(14):
        moved = theta.copy()
        moved[:, k] += 1e-6
        change = (smallnets.outputs(moved, x, 2)[0] - smallnets.outputs(theta, x, 2)[0]) / 1e-6
        assert slopes[:, :, k] == pytest.approx(change, abs=1e-4)
