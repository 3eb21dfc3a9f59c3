"""Trees grown in stacks against trees grown one node at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import treegrow
from fluxloom.plans import trees
from fluxloom.plans.common import FITS


def plain_tree(x, y, w, depth, least, ridge, path=0):
    """A tree as nested tuples: (predictor, cut, left, right) or a value; all predictors tried, all cuts compared.

    Predictors are tried in the order drawn for the node, as few rows are often cut alike by several.
    """
    value = (w * y).sum() / (w.sum() + ridge)
    best = (1e-9, None, None)
    if depth > 0 and w.sum() > least:
        whole = (w * y).sum() ** 2 / (w.sum() + ridge)
        for f in np.argsort(treegrow.mixed(np.uint64(path) * np.uint64(5) + np.arange(5, dtype=np.uint64)), kind="stable"):
            values = np.unique(x[:, f])
            for a, b in zip(values[:-1], values[1:], strict=True):
                low = x[:, f] <= a
                gain = sum((w[s] * y[s]).sum() ** 2 / (w[s].sum() + ridge) for s in (low, ~low)) - whole
                if gain > best[0]:
                    best = (gain, f, a + (b - a) / 2)
    if best[1] is None:
        return value
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], *[plain_tree(x[s], y[s], w[s], depth - 1, least, ridge, onward(path, k)) for k, s in enumerate((low, ~low))])


def onward(path, side):
    with np.errstate(over="ignore"):
        return treegrow.mixed(np.array([path], np.uint64) * np.uint64(2) + np.uint64(side))[0]


def predicted(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def designs(fits=4, seed=3):
    rng = np.random.default_rng(seed)
    xs = [rng.normal(size=(int(n), 5)) for n in rng.integers(12, 40, fits)]
    ys = [1000 + 50 * x[:, 1] + 20 * x[:, 3] ** 2 + rng.normal(size=len(x)) for x in xs]
    return xs, ys, [rng.normal(size=(9, 5)) for _ in xs], [int(s) for s in rng.integers(-(2**62), 2**62, fits)]


def test_forest_is_the_mean_of_plain_trees(monkeypatch):
    monkeypatch.setattr(treegrow, "ENTRIES", 800)
    xs, ys, new, seeds = designs()
    got = treegrow.forests(xs, ys, new, seeds, trees=25, tried=5, least=5, depth=60, importance=True)
    for x, y, m, seed, one in zip(xs, ys, new, seeds, got, strict=True):
        draws = np.random.default_rng(seed & (2**63 - 1)).multinomial(len(y), np.full(len(y), 1 / len(y)), 25)
        roots = treegrow.mixed(np.uint64(seed & (2**64 - 1)) + np.arange(25, dtype=np.uint64))
        grown = [plain_tree(x[w > 0], y[w > 0] - y.mean(), w[w > 0].astype(float), 60, 5, 0.0, r) for w, r in zip(draws, roots, strict=True)]
        ahead = [np.mean([predicted(t, r) for t in grown]) + y.mean() for r in m]
        assert one.new == pytest.approx(ahead, rel=1e-6)
        outside = [[predicted(t, r) for t, w in zip(grown, draws[:, i], strict=True) if w == 0] for i, r in enumerate(x)]
        assert one.rows == pytest.approx([np.mean(v) + y.mean() if v else np.nan for v in outside], rel=1e-6, nan_ok=True)
        errors = [np.mean([(predicted(t, x[i]) + y.mean() - y[i]) ** 2 for i in np.flatnonzero(w == 0)]) for t, w in zip(grown, draws, strict=True)]
        assert one.base == pytest.approx(np.mean(errors), rel=1e-6)
        assert one.rise[1] > 5 * one.spread[1] / 5 and one.rise.argmax() == 1


def test_fits_do_not_depend_on_their_stack():
    xs, ys, new, seeds = designs(5, 8)
    together = treegrow.forests(xs, ys, new, seeds, 30, 1, 5, 60, True)
    apart = [treegrow.forests([x], [y], [m], [s], 30, 1, 5, 60, True)[0] for x, y, m, s in zip(xs, ys, new, seeds, strict=True)]
    for a, b in zip(together, apart, strict=True):
        assert (a.rows == b.rows).all() and (a.new == b.new).all() and (a.rise == b.rise).all()
    settings = dict(rounds=30, folds=10, patience=2, rate=0.3, depth=6, ridge=1.0)
    together = treegrow.boosted(xs, ys, new, seeds, **settings)
    for a, x, y, m, s in zip(together, xs, ys, new, seeds, strict=True):
        b = treegrow.boosted([x], [y], [m], [s], **settings)[0]
        assert a.rounds == b.rounds and (a.rows == b.rows).all() and (a.new == b.new).all()


def plain_boosting(x, y, rounds, start, depth, ridge):
    """Predictions of a function after each round."""
    tree_list, now, curve = [], np.full(len(y), start), []
    for _ in range(rounds):
        tree = plain_tree(x, y - now, np.ones(len(y)), depth, 1, ridge)
        tree_list.append(tree)
        now = now + 0.3 * np.array([predicted(tree, r) for r in x])
        curve.append(list(tree_list))
    return lambda rows, n: start + 0.3 * np.array([sum(predicted(t, r) for t in tree_list[:n]) for r in rows])


def test_boosting_equals_a_plain_loop():
    xs, ys, new, seeds = designs(2, 5)
    got = treegrow.boosted(xs, ys, new, seeds, rounds=12, folds=4, patience=2, rate=0.3, depth=3, ridge=1.0)
    for x, y, m, seed, one in zip(xs, ys, new, seeds, got, strict=True):
        fold = np.random.default_rng(seed & (2**63 - 1)).permutation(len(y)) % 4
        fits = [plain_boosting(x[fold != k], y[fold != k], 12, y[fold != k].mean(), 3, 1.0) for k in range(4)]
        curve = [np.mean([np.sqrt(np.mean((f(x[fold == k], n) - y[fold == k]) ** 2)) for k, f in enumerate(fits)]) for n in range(1, 13)]
        best = 0
        for n, error in enumerate(curve):
            if error < curve[best]:
                best = n
            elif n - best >= 2:
                break
        assert one.rounds == best + 1
        whole = plain_boosting(x, y, best + 1, y.mean(), 3, 1.0)
        assert one.rows == pytest.approx(whole(x, best + 1), rel=1e-6)
        assert one.new == pytest.approx(whole(m, best + 1), rel=1e-6)


def test_constant_tied_and_tiny_fits():
    x = [np.zeros((12, 5)), np.repeat(np.arange(6.0), 2)[:, None] * np.ones(5), np.ones((1, 5))]
    y = [np.full(12, 7.0), np.repeat(np.arange(6.0), 2), np.array([3.0])]
    new = [np.zeros((2, 5)), np.zeros((0, 5)), np.ones((1, 5))]
    forest = treegrow.forests(x, y, new, [1, 2, 3], 40, 1, 1, 60)
    assert forest[0].new.tolist() == [7.0, 7.0] and forest[1].new.tolist() == [] and forest[2].new.tolist() == [3.0]
    assert np.isnan(forest[2].rows).all()
    boost = treegrow.boosted(x, y, new, [1, 2, 3], 20, 10, 2, 0.3, 6, 1.0)
    assert boost[0].rows.tolist() == [7.0] * 12 and boost[2].new.tolist() == [3.0]


def test_one_row_per_training_month(spark):
    rows = spark.range(60).select(
        F.lit("p").alias("project_id"), (F.col("id") % 3).cast("string").alias("site_id"), F.lit("v").alias("variable"), F.lit("2001-01-01").cast("date").alias("issue"),
        F.add_months(F.lit("1999-01-01"), F.floor(F.col("id") / 3).cast("int")).alias("datetime"), F.col("id").cast("double").alias("observation"),
        *[F.sin(F.col("id") * (i + 1)).alias(p) for i, p in enumerate(trees.PREDICTORS)],
    )
    fits = trees.solved(trees.packed_fits(rows, FITS), FITS, trees.forest_solver(20)).collect()
    assert len(fits) == 3
    for r in fits:
        assert len(r.at) == len(r.y) == len(r.fitted) == 20 and list(r.at) == sorted(r.at) and r.members == [] and r.residual_sd > 0
