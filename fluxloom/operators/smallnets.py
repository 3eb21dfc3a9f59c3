"""Two-layer nets of many fits at once, regularised by evidence: Gauss-Newton steps on a stack in numpy.

A net is the sum over units of w tanh(b + v.x), on targets scaled to -1 .. 1. All its parameters share one
Gaussian prior. Its weight and the noise's follow from the number of parameters that the data determine
(MacKay 1992; Foresee and Hagan 1997).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Steps at most, and relative change of the objective and the prior at which a fit rests: of the net that is kept, and of
#: those that only compare numbers of units.
KEPT, COMPARED = (200, 1e-10, 1e-6), (40, 1e-3, 0.1)
#: Fits times rows that are held at once.
ROWS = 1 << 17
#: Nets that take steps together.
HELD = 256


def outputs(theta: np.ndarray, x: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """Outputs (m, n) and their slopes by parameter (m, n, P); ``theta`` holds w, b and v of each unit in turn."""
    m, n, p = x.shape
    t = theta.reshape(m, units, p + 2)
    h = np.tanh(t[:, None, :, 1] + np.einsum("mnp,mup->mnu", x, t[:, :, 2:]))
    inner = t[:, None, :, 0] * (1 - h * h)
    slopes = np.concatenate([h[..., None], inner[..., None], inner[..., None] * x[:, :, None, :]], axis=3)
    return np.einsum("mnu,mu->mn", h, t[:, :, 0]), slopes.reshape(m, n, -1)


def _hidden(theta: np.ndarray, z: np.ndarray, y: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """Units' outputs (m, units, n) and errors (m, n) on inputs (m, 1 + p, n) that begin with a one; a column of zeros counts for nothing."""
    t = theta.reshape(len(theta), units, z.shape[1] + 1)
    h = np.tanh(t[:, :, 1:] @ z)
    return h, y - (t[:, None, :, 0] @ h)[:, 0]


def _products(theta: np.ndarray, z: np.ndarray, h: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of the slopes among each other (m, P, P) and with the errors (m, P)."""
    m, units, n = h.shape
    width = z.shape[1] + 1
    w = theta.reshape(m, units, width)[:, :, :1]
    slopes = np.empty((m, units, width, n))
    slopes[:, :, 0] = h
    np.multiply((w * (1 - h * h))[:, :, None], z[:, None], out=slopes[:, :, 1:])
    j = slopes.reshape(m, units * width, n)
    return j @ j.transpose(0, 2, 1), (j @ e[:, :, None])[..., 0]


def fit_nets(x: np.ndarray, y: np.ndarray, used: np.ndarray, units: int, seeds: Sequence[int], until: tuple = KEPT) -> np.ndarray:
    """Parameters of each fit of a stack (m, n, p); rows with ``used`` false do not count.

    Fits go through in parts of ``HELD``, whose slopes stay in the processor's cache.
    """
    size = units * (x.shape[2] + 2)
    theta = np.zeros((len(x), size))
    for start in range(0, len(x), HELD):
        at = slice(start, start + HELD)
        first = np.stack([np.random.default_rng(s & (2**63 - 1)).normal(scale=0.5, size=size) for s in seeds[at]])
        z = np.concatenate([used[at, :, None], x[at] * used[at, :, None]], axis=2).transpose(0, 2, 1)
        theta[at] = _fit_part(first, np.ascontiguousarray(z), y[at] * used[at], used[at].sum(axis=1), units, until)
    return theta


def _fit_part(theta: np.ndarray, z: np.ndarray, y: np.ndarray, rows: np.ndarray, units: int, until: tuple) -> np.ndarray:
    """Steps from ``theta`` until each fit rests. Slopes are taken once a step, and only where the last trial was better."""
    m, size = theta.shape
    out, place, diagonal = theta.copy(), np.arange(m), np.arange(size)
    prior, noise, damping = np.full(m, 0.01), np.ones(m), np.full(m, 0.005)
    h, e = _hidden(theta, z, y, units)
    (curve, slope), square = _products(theta, z, h, e), (e * e).sum(1)
    steps, least, steady = until
    for _ in range(steps):
        a, b = prior, noise
        before = b * square + a * (theta**2).sum(1)
        damped = b[:, None, None] * curve
        damped[:, diagonal, diagonal] += (a + damping)[:, None]
        step = np.linalg.solve(damped, (b[:, None] * slope - a[:, None] * theta)[..., None])[..., 0]
        new = theta + step
        h, e = _hidden(new, z, y, units)
        new_square, new_size = (e * e).sum(1), (new**2).sum(1)
        after = b * new_square + a * new_size
        better = after < before
        at = np.flatnonzero(better)
        damping = np.where(better, np.maximum(damping / 10, 1e-12), damping * 10)
        held = b[at, None, None] * curve[at]
        held[:, diagonal, diagonal] += a[at, None]
        known = size - a[at] * np.trace(np.linalg.inv(held), axis1=1, axis2=2)
        known = np.clip(known, 1e-6, np.maximum(rows[at] - 1e-3, 1e-3))
        prior, noise = a.copy(), b.copy()
        prior[at] = known / np.maximum(2 * new_size[at], 1e-12)
        noise[at] = (rows[at] - known) / np.maximum(2 * new_square[at], 1e-12)
        rest = (better & (before - after <= least * before) & (np.abs(prior - a) <= steady * a)) | (damping > 1e10)
        theta = np.where(better[:, None], new, theta)
        out[place[rest]] = theta[rest]
        go = np.flatnonzero(~rest)
        if not len(go):
            return out
        # Slopes at the new place, of those that moved and go on.
        moved = np.flatnonzero(better & ~rest)
        curve[moved], slope[moved] = _products(theta[moved], z[moved], h[moved], e[moved])
        square[moved] = new_square[moved]
        if len(go) < len(rest):
            place, theta, z, y, rows, prior, noise, damping, curve, slope, square = (
                v[go] for v in (place, theta, z, y, rows, prior, noise, damping, curve, slope, square)
            )
    out[place] = theta
    return out


def _scaled(ys: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Middle and half of the range of each fit's targets."""
    low, high = np.array([y.min() for y in ys]), np.array([y.max() for y in ys])
    return (low + high) / 2, np.where(high > low, (high - low) / 2, 1.0)


def chosen_nets(xs: Sequence[np.ndarray], ys: Sequence[np.ndarray], seeds: Sequence[int], units: Sequence[int], folds: int, repeats: int) -> list[tuple]:
    """(units, parameters, middle, half range) of each fit: the number of units by repeated cross-validation.

    Fits of a stack are padded to the longest; padding does not count.
    """
    out = []
    each = max(1, ROWS // max(1, max((len(y) for y in ys), default=1) * folds * repeats))
    for start in range(0, len(ys), each):
        out += _chosen(xs[start : start + each], ys[start : start + each], seeds[start : start + each], units, folds, repeats)
    return out


def _chosen(xs, ys, seeds, units, folds, repeats):
    m, n, p = len(ys), max(len(y) for y in ys), xs[0].shape[1]
    middle, half = _scaled(ys)
    x, y, used, fold = np.zeros((m, n, p)), np.zeros((m, n)), np.zeros((m, n), bool), np.full((m, repeats, n), -1)
    for i, (a, b, seed) in enumerate(zip(xs, ys, seeds, strict=True)):
        k = len(b)
        x[i, :k], y[i, :k], used[i, :k] = a, (b - middle[i]) / half[i], True
        rng = np.random.default_rng(seed & (2**63 - 1))
        fold[i, :, :k] = np.stack([rng.permutation(k) % folds for _ in range(repeats)])
    own = np.repeat(np.arange(m), repeats * folds)
    out_of = (fold[:, :, None, :] == np.arange(folds)[None, None, :, None]).reshape(m * repeats * folds, n)
    turn = [s + k for s in seeds for k in range(repeats * folds)]
    errors = np.zeros((len(units), m))
    for u, count in enumerate(units):
        theta = fit_nets(x[own], y[own], used[own] & ~out_of, count, turn, COMPARED)
        gap = (outputs(theta, x[own], count)[0] - y[own]) * out_of
        np.add.at(errors[u], own, (gap * gap).sum(axis=1))
    best = errors.argmin(axis=0)
    out = [None] * m
    for u, count in enumerate(units):
        at = np.flatnonzero(best == u)
        if len(at):
            theta = fit_nets(x[at], y[at], used[at], count, [seeds[i] for i in at])
            for i, t in zip(at.tolist(), theta, strict=True):
                out[i] = (count, t, float(middle[i]), float(half[i]))
    return out
