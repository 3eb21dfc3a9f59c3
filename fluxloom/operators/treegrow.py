"""Regression trees of many fits at once: all trees of a stack grow level by level in numpy.

An entry is one row in one tree, with a weight. Each level sorts the entries of every open node by one
predictor and finds the best cut of all nodes from running sums. Targets are held as integers, so sums are
exact and a tree does not depend on which other fits share its stack.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

#: Entries of a stack; larger ones are grown in parts of whole fits.
ENTRIES = 1 << 18
#: Targets are held in steps of this part of their largest value.
STEPS = float(1 << 30)


def mixed(h: np.ndarray) -> np.ndarray:
    """Numbers that look random, one per input, the same on every machine."""
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


@dataclass
class Stack:
    """Rows of several fits one after another: predictors, fit of each row, first row of each fit."""

    x: np.ndarray
    fit: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, designs: Sequence[np.ndarray]) -> Stack:
        sizes = np.array([len(d) for d in designs], np.int64)
        return cls(np.concatenate(designs), np.repeat(np.arange(len(designs)), sizes), np.concatenate([[0], np.cumsum(sizes)]))

    def ranks(self) -> np.ndarray:
        """Dense rank of every value among its fit's values of that predictor."""
        out = np.empty(self.x.shape, np.int64)
        for f in range(self.x.shape[1]):
            order = np.lexsort((self.x[:, f], self.fit))
            value, fit = self.x[order, f], self.fit[order]
            new = np.concatenate([[True], (value[1:] != value[:-1]) | (fit[1:] != fit[:-1])])
            place = np.cumsum(new)
            first = place[np.searchsorted(fit, fit, side="left")]
            out[order, f] = place - first
        return out


@dataclass
class Trees:
    """Nodes of all trees; root k is node k. ``feature`` is -1 at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def leaves(self, tree: np.ndarray, value_at: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The leaf of each entry; ``value_at(entries, features)`` gives the predictors asked for."""
        node = tree.astype(np.int64)
        open_ = np.flatnonzero(self.feature[node] >= 0)
        while len(open_):
            at = node[open_]
            right = value_at(open_, self.feature[at]) > self.cut[at]
            node[open_] = self.left[at] + right
            open_ = open_[self.feature[node[open_]] >= 0]
        return node


def grow(
    stack: Stack, ranks: np.ndarray, tree: np.ndarray, row: np.ndarray, weight: np.ndarray, target: np.ndarray, seeds: np.ndarray,
    tried: int, depth: int, least: int, ridge: float,
) -> Trees:
    """Trees on entries (tree, row, whole weight, whole target), one per seed.

    A node is cut where the sum of squared sums per weight, ``ridge`` added to weights, rises most over
    ``tried`` predictors drawn for the node; not below ``least`` + 1 of weight nor beyond ``depth``. Equal cuts
    go to the predictor drawn first and the lower value. ``value`` is sum / (weight + ridge), in steps.
    """
    n, p = len(seeds), ranks.shape[1]
    span = int(ranks.max(initial=0)) + 1
    feature, cut, left, value = [], [], [], []
    node, total, path = tree.astype(np.int64), weight * target, seeds.astype(np.uint64)
    base, count = 0, n
    for level in range(depth + 1):
        w = np.bincount(node, weight, count).astype(np.int64)
        s = np.zeros(count, np.int64)
        np.add.at(s, node, total)
        value.append(s / np.maximum(w + ridge, 1e-300))
        best, chosen = np.full(count, 1e-9 * STEPS * STEPS), np.full(count, -1)
        where, least_rank = np.zeros(count), np.zeros(count, np.int64)
        drawn = np.argsort(mixed(path[:, None] * np.uint64(p) + np.arange(p, dtype=np.uint64)), axis=1, kind="stable")[:, :tried]
        inside = np.flatnonzero((w > least)[node]) if level < depth else np.zeros(0, np.int64)
        for k in range(tried if len(inside) else 0):
            at = node[inside]
            f = drawn[at, k]
            rank = ranks[row[inside], f]
            order = np.argsort(at * span + rank, kind="stable")
            by, at, rank = inside[order], at[order], rank[order]
            first = np.concatenate([[True], at[1:] != at[:-1]])
            starts = np.flatnonzero(first)
            cw, cs = np.cumsum(weight[by]), np.cumsum(total[by])
            before = np.repeat(starts, np.diff(np.append(starts, len(at))))
            lw = cw - cw[before] + weight[by[before]]
            ls = cs - cs[before] + total[by[before]]
            rw, rs = w[at] - lw, s[at] - ls
            apart = np.concatenate([(at[1:] == at[:-1]) & (rank[1:] != rank[:-1]), [False]])
            i = np.flatnonzero(apart)
            if not len(i):
                continue
            score = lambda a, b: a.astype(float) ** 2 / (b + ridge)
            gain = score(ls[i], lw[i]) + score(rs[i], rw[i]) - score(s[at[i]], w[at[i]])
            top = np.full(count, -np.inf)
            np.maximum.at(top, at[i], gain)
            hit = i[(gain == top[at[i]]) & (gain > best[at[i]])]
            hit = hit[np.concatenate([[True], at[hit][1:] != at[hit][:-1]])] if len(hit) else hit
            own = at[hit]
            best[own], chosen[own] = top[own], drawn[own, k]
            low, high = stack.x[row[by[hit]], drawn[own, k]], stack.x[row[by[hit + 1]], drawn[own, k]]
            middle = low + (high - low) / 2
            where[own], least_rank[own] = np.where(middle < high, middle, low), rank[hit]
        split = np.flatnonzero(chosen >= 0)
        feature.append(chosen)
        cut.append(where)
        child = np.full(count, -1)
        child[split] = base + count + 2 * np.arange(len(split))
        left.append(child)
        if not len(split):
            break
        stay = chosen[node] >= 0
        node, row, weight, total = node[stay], row[stay], weight[stay], total[stay]
        right = ranks[row, chosen[node]] > least_rank[node]
        node = child[node] - base - count + right
        path = mixed(np.repeat(path[split], 2) * np.uint64(2) + np.tile(np.arange(2, dtype=np.uint64), len(split)))
        base, count = base + count, 2 * len(split)
    return Trees(*map(np.concatenate, (feature, cut, left, value)))


def grow_by_one(
    stack: Stack, ranks: np.ndarray, tree: np.ndarray, row: np.ndarray, weight: np.ndarray, target: np.ndarray, seeds: np.ndarray,
    depth: int, least: int, ridge: float,
) -> Trees:
    """``grow`` for one predictor drawn per node, entries in order of trees.

    A level's one sort by node and value leaves each node's entries in order of its cut, so its children are the
    parts before and after it: weights and sums of children are the running sums at the cut.
    """
    n, p = len(seeds), ranks.shape[1]
    span = int(ranks.max(initial=0)) + 1
    flat_ranks, flat_x = ranks.ravel(), stack.x.ravel()
    feature, cut, left, value = [], [], [], []
    total, path, first = weight * target, seeds.astype(np.uint64), row * p
    size = np.bincount(tree, minlength=n)
    sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], np.cumsum(size)])])
    w, s = sums(weight), sums(total)
    score = lambda a, b: a.astype(float) ** 2 / (b + ridge)
    base, count = 0, n
    for level in range(depth + 1):
        value.append(s / np.maximum(w + ridge, 1e-300))
        chosen, where, child = np.full(count, -1), np.zeros(count), np.full(count, -1)
        feature.append(chosen)
        cut.append(where)
        left.append(child)
        drawn = mixed(path[:, None] * np.uint64(p) + np.arange(p, dtype=np.uint64)).argmin(axis=1)
        inside = (w > least) & (level < depth)
        if not inside.all():
            stay = np.flatnonzero(np.repeat(inside, size))
            first, weight, total = first[stay], weight[stay], total[stay]
        node = np.flatnonzero(inside)
        if not len(node):
            break
        size, w, s, f = size[node], w[node], s[node], drawn[node]
        ends = np.cumsum(size)
        at = np.repeat(np.arange(len(node)), size)
        rank = flat_ranks.take(first + np.repeat(f, size))
        bits = int(len(at)).bit_length()
        key = ((at * span + rank) << bits) | np.arange(len(at))
        key.sort()
        by = key & ((1 << bits) - 1)
        first, weight, total, key = first[by], weight[by], total[by], key >> bits
        apart = key[1:] != key[:-1]
        apart[ends[:-1] - 1] = False
        i = np.flatnonzero(apart)
        if not len(i):
            break
        cw, cs, own = np.cumsum(weight), np.cumsum(total), at[i]
        lw, ls = cw[i] - (cw[ends - 1] - w)[own], cs[i] - (cs[ends - 1] - s)[own]
        gain = score(ls, lw) + score(s[own] - ls, w[own] - lw) - score(s, w)[own]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        top = np.repeat(np.maximum.reduceat(gain, starts), np.diff(np.append(starts, len(i))))
        hit = np.flatnonzero((gain == top) & (gain > 1e-9 * STEPS * STEPS))
        if not len(hit):
            break
        hit = hit[np.concatenate([[True], own[hit][1:] != own[hit][:-1]])]
        split, place = own[hit], i[hit]
        low, high = flat_x.take(first[place] + f[split]), flat_x.take(first[place + 1] + f[split])
        middle = low + (high - low) / 2
        parent = node[split]
        chosen[parent], where[parent] = f[split], np.where(middle < high, middle, low)
        child[parent] = base + count + 2 * np.arange(len(split))
        if len(split) < len(node):
            cutting = np.zeros(len(node), bool)
            cutting[split] = True
            stay = np.flatnonzero(np.repeat(cutting, size))
            first, weight, total = first[stay], weight[stay], total[stay]
        before = place - (ends - size)[split] + 1
        pairs = lambda a, b: np.stack([a, b], axis=1).ravel()
        size, w, s = pairs(before, size[split] - before), pairs(lw[hit], w[split] - lw[hit]), pairs(ls[hit], s[split] - ls[hit])
        path = mixed(np.repeat(path[parent], 2) * np.uint64(2) + np.tile(np.arange(2, dtype=np.uint64), len(split)))
        base, count = base + count, 2 * len(split)
    return Trees(*map(np.concatenate, (feature, cut, left, value)))


def _parts(sizes: Sequence[int], trees: int) -> list[list[int]]:
    """Fits in order, in parts of about ENTRIES entries."""
    parts, held = [[]], 0
    for i, size in enumerate(sizes):
        if parts[-1] and held + size * trees > ENTRIES:
            parts.append([])
            held = 0
        parts[-1].append(i)
        held += size * trees
    return parts


def _steps(values: np.ndarray, fit: np.ndarray, fits: int) -> tuple[np.ndarray, np.ndarray]:
    """Values as whole steps and the size of a step of each fit."""
    most = np.zeros(fits)
    np.maximum.at(most, fit, np.abs(values))
    step = np.where(most > 0, most, 1.0) / STEPS
    return np.rint(values / step[fit]).astype(np.int64), step


@dataclass
class Fitted:
    """Of one fit: predictions of its rows and of new rows, rounds of boosting, importance per predictor."""

    rows: np.ndarray
    new: np.ndarray
    rounds: int = 0
    base: float = float("nan")
    rise: np.ndarray | None = None
    spread: np.ndarray | None = None


def forests(
    designs: Sequence[np.ndarray], targets: Sequence[np.ndarray], new: Sequence[np.ndarray], seeds: Sequence[int],
    trees: int, tried: int, least: int, depth: int, importance: bool = False,
) -> list[Fitted]:
    """A random forest per fit. A fit's own rows are predicted by the trees that did not draw them (out of bag).

    With ``importance``, each predictor is shuffled among a tree's out-of-bag rows; ``base`` is the mean error of
    the trees, ``rise`` its mean rise per predictor and ``spread`` the standard error of that rise.
    """
    out = []
    for part in _parts([len(d) + len(m) for d, m in zip(designs, new, strict=True)], trees):
        out += _forests([designs[i] for i in part], [targets[i] for i in part], [new[i] for i in part], [seeds[i] for i in part],
                        trees, tried, least, depth, importance)
    return out


def _forests(designs, targets, new, seeds, trees, tried, least, depth, importance) -> list[Fitted]:
    stack, fits = Stack.of(designs), len(designs)
    mean = np.array([t.mean() for t in targets])
    y = np.concatenate(targets) - mean[np.arange(fits)[stack.fit]]
    target, step = _steps(y, stack.fit, fits)
    draws = [np.random.default_rng(seed & (2**63 - 1)).multinomial(len(d), np.full(len(d), 1 / len(d)), trees) for d, seed in zip(designs, seeds, strict=True)]
    tree = np.concatenate([np.repeat(np.arange(k * trees, (k + 1) * trees), len(d)) for k, d in enumerate(designs)])
    row = np.concatenate([np.tile(np.arange(stack.start[k], stack.start[k + 1]), trees) for k in range(fits)])
    weight = np.concatenate([w.ravel() for w in draws])
    roots = mixed(np.repeat(np.array([s & (2**64 - 1) for s in seeds], np.uint64), trees) + np.tile(np.arange(trees, dtype=np.uint64), fits))
    drawn, others = np.flatnonzero(weight), np.flatnonzero(weight == 0)
    entries = (stack, stack.ranks(), tree.take(drawn), row.take(drawn), weight.take(drawn), target.take(row.take(drawn)), roots)
    grown = grow_by_one(*entries, depth, least, 0.0) if tried == 1 else grow(*entries, tried, depth, least, 0.0)
    scale = np.repeat(step, trees)
    left_out, own = row.take(others), tree.take(others)
    flat, width = stack.x.ravel(), stack.x.shape[1]
    first = left_out * width
    votes = grown.value[grown.leaves(own, lambda e, f: flat.take(first[e] + f))] * scale[own]
    seen = np.bincount(left_out, minlength=len(y))
    with np.errstate(invalid="ignore"):
        outside = np.bincount(left_out, votes, len(y)) / np.where(seen > 0, seen, np.nan)
    fitted = [Fitted(outside[a:b] + m, np.zeros(0)) for a, b, m in zip(stack.start[:-1], stack.start[1:], mean, strict=True)]
    for k, rows in enumerate(new):
        if len(rows):
            asked, wanted = np.tile(np.arange(len(rows)) * width, trees), np.ravel(rows)
            leaf = grown.leaves(np.repeat(np.arange(k * trees, (k + 1) * trees), len(rows)), lambda e, f, asked=asked, wanted=wanted: wanted.take(asked[e] + f))
            fitted[k].new = (grown.value[leaf] * step[k]).reshape(trees, -1).mean(axis=0) + mean[k]
    if importance:
        _importance(fitted, stack, grown, left_out, own, y, votes, scale, roots, trees)
    return fitted


def _importance(fitted, stack, grown, row, tree, y, votes, scale, roots, trees) -> None:
    """Rise of each tree's out-of-bag error when one predictor's values change places among its rows."""
    n, p = np.bincount(tree, minlength=len(roots)), stack.x.shape[1]
    error = lambda v: np.bincount(tree, (v - y[row]) ** 2, len(roots)) / np.maximum(n, 1)
    base = error(votes)
    rises = []
    for f in range(p):
        lot = mixed(roots[tree] + np.uint64(0x9E37 + f) * (row - stack.start[stack.fit[row]] + 1).astype(np.uint64))
        order = np.lexsort((lot, tree))
        donor = np.empty_like(row)
        # Entries are in order of trees: the k-th of a tree takes its value from the one of k-th lot.
        donor[np.argsort(tree, kind="stable")] = row[order]
        leaf = grown.leaves(tree, lambda e, g, f=f, donor=donor: stack.x[np.where(g == f, donor[e], row[e]), g])
        rises.append(error(grown.value[leaf] * scale[tree]) - base)
    used = n > 0
    for k, one in enumerate(fitted):
        mine = slice(k * trees, (k + 1) * trees)
        some = used[mine]
        one.base = base[mine][some].mean()
        rise = np.array([r[mine][some] for r in rises])
        one.rise, one.spread = rise.mean(axis=1), rise.std(axis=1) / np.sqrt(some.sum())


class _Boosters:
    """Boosted trees of several fits or folds, one round at a time. Entries with weight 0 are predicted only."""

    def __init__(self, stack, ranks, y, booster, row, weight, base, rate, depth, ridge):
        self.stack, self.ranks, self.rate, self.depth, self.ridge = stack, ranks, rate, depth, ridge
        self.y, self.booster, self.row, self.weight = y[row], booster, row, weight
        self.now = base[booster]

    def keep(self, wanted: np.ndarray) -> None:
        """Only boosters marked go on; they keep their numbers."""
        stay = wanted[self.booster]
        for name in ("y", "booster", "row", "weight", "now"):
            setattr(self, name, getattr(self, name)[stay])

    def round(self) -> Callable[[int, np.ndarray], np.ndarray]:
        """One tree per booster; returns what it adds to new rows of a booster."""
        names, own = np.unique(self.booster, return_inverse=True)
        used = self.weight > 0
        target, step = _steps((self.y - self.now)[used], own[used], len(names))
        seeds = np.zeros(len(names), np.uint64)
        grown = grow(self.stack, self.ranks, own[used], self.row[used], self.weight[used], target, seeds, self.ranks.shape[1], self.depth, 1, self.ridge)
        leaf = grown.leaves(own, lambda e, f: self.stack.x[self.row[e], f])
        self.now = self.now + self.rate * grown.value[leaf] * step[own]
        place = {int(b): k for k, b in enumerate(names)}

        def added(booster: int, rows: np.ndarray) -> np.ndarray:
            k = place[booster]
            return self.rate * step[k] * grown.value[grown.leaves(np.full(len(rows), k), lambda e, f: rows[e, f])]

        return added


def chosen_rounds(stack: Stack, ranks, y, seeds, rounds: int, folds: int, patience: int, rate: float, depth: int, ridge: float) -> np.ndarray:
    """Rounds of each fit with the least mean held-out error; a fit stops after ``patience`` rounds without a better one."""
    fits = len(stack.start) - 1
    sizes = np.diff(stack.start)
    fold = np.concatenate([np.random.default_rng(s & (2**63 - 1)).permutation(n) % folds for s, n in zip(seeds, sizes, strict=True)])
    row = np.repeat(np.arange(len(y)), folds)
    turn = np.tile(np.arange(folds), len(y))
    booster = stack.fit[row] * folds + turn
    weight = (fold[row] != turn).astype(np.int64)
    count = np.bincount(booster, weight, fits * folds)
    base = np.bincount(booster, weight * y[row], fits * folds) / np.maximum(count, 1)
    state = _Boosters(stack, ranks, y, booster, row, weight, base, rate, depth, ridge)
    best, error, since = np.ones(fits, np.int64), np.full(fits, np.inf), np.zeros(fits, np.int64)
    live = np.ones(fits, bool)
    for number in range(1, rounds + 1):
        state.keep(np.repeat(live, folds))
        if not len(state.row):
            break
        state.round()
        out = state.weight == 0
        squares = np.bincount(state.booster[out], (state.now - state.y)[out] ** 2, fits * folds)
        held = np.bincount(state.booster[out], minlength=fits * folds)
        rmse = np.sqrt(squares / np.maximum(held, 1)).reshape(fits, folds)
        mean = rmse.sum(axis=1) / np.maximum((held.reshape(fits, folds) > 0).sum(axis=1), 1)
        better = live & (mean < error)
        error[better], best[better], since[better] = mean[better], number, 0
        since[live & ~better] += 1
        live &= since < patience
    return best


def boosted(
    designs: Sequence[np.ndarray], targets: Sequence[np.ndarray], new: Sequence[np.ndarray], seeds: Sequence[int],
    rounds: int, folds: int, patience: int, rate: float, depth: int, ridge: float,
) -> list[Fitted]:
    """Boosted trees per fit, rounds by cross-validation; a fit's own rows are predicted in sample."""
    out = []
    for part in _parts([len(d) for d in designs], folds):
        stack = Stack.of([designs[i] for i in part])
        ranks, y = stack.ranks(), np.concatenate([targets[i] for i in part])
        own = [seeds[i] for i in part]
        best = chosen_rounds(stack, ranks, y, own, rounds, folds, patience, rate, depth, ridge)
        base = np.bincount(stack.fit, y) / np.diff(stack.start)
        state = _Boosters(stack, ranks, y, stack.fit, np.arange(len(y)), np.ones(len(y), np.int64), base, rate, depth, ridge)
        rows, ahead = base[stack.fit], [np.full(len(new[i]), base[k]) for k, i in enumerate(part)]
        for number in range(int(best.max(initial=0))):
            live = best > number
            state.keep(live)
            added = state.round()
            rows[state.row] = state.now
            for k in np.flatnonzero(live).tolist():
                if len(ahead[k]):
                    ahead[k] = ahead[k] + added(k, new[part[k]])
        out += [Fitted(rows[a:b], m, int(r)) for a, b, m, r in zip(stack.start[:-1], stack.start[1:], ahead, best, strict=True)]
    return out
