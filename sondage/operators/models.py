"""Nested cross-validation on DataFrames: lanes that take the rows of a repeat once and many jobs on them, trainers in numpy that expand a block of rows at a time."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sondage.functions import rng
from sondage.session import ship


@dataclass(frozen=True)
class Settings:
    """Cross-validation settings."""

    outer: int = 5
    inner: int = 4
    target_sensitivity: float = 0.90
    ensemble: bool = False


def auc(y: np.ndarray, p: np.ndarray) -> float:
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    if not pos or not neg:
        return float("nan")
    if (p >= 0).all():
        # Doubles from 0 sort like whole numbers, whose highest bit is free: the outcome goes below the lowest.
        both = (p + 0.0).view(np.int64)
        both <<= 1
        both |= y == 1
        both.sort()
        ones = (both & 1).astype(bool)
        both >>= 1
        if (new := both[1:] != both[:-1]).all():
            ranks = np.flatnonzero(ones).sum() + pos
        else:
            start = np.concatenate([[0], np.flatnonzero(new) + 1])
            ranks = (np.add.reduceat(ones, start, dtype=np.int64) * (start + np.append(start[1:], len(both)) + 1) / 2).sum()
    else:
        ranks = pd.Series(p).rank().to_numpy()[y == 1].sum()
    return float((ranks - pos * (pos + 1) / 2) / (pos * neg))


class Scale:
    """Median imputation and z-scores by the population deviation of the training rows."""

    def __init__(self, x: np.ndarray):
        each = []
        for c in x.T:
            known = c[~np.isnan(c)]
            middle = float(np.median(known)) if len(known) else 0.0
            filled = np.where(np.isnan(c), middle, c)
            mean = filled.cumsum()[-1] / len(c)
            filled -= mean
            filled *= filled
            each.append((middle, mean, np.sqrt(filled.cumsum()[-1] / len(c))))
        self.middle, self.mean, sd = np.array(each).reshape(-1, 3).T
        self.sd = np.where(sd > 0, sd, 1.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.over(x.copy())

    def over(self, x: np.ndarray) -> np.ndarray:
        """The z-scores in the place of x."""
        for j in range(x.shape[1]):
            c = x[:, j]
            c[np.isnan(c)] = self.middle[j]
            c -= self.mean[j]
            c /= self.sd[j]
        return x


class Prior:
    """The training prevalence for every row."""

    def __init__(self, x, y):
        self.p = float(y.mean())

    def __call__(self, x):
        return np.full(len(x), self.p)


#: Entries of a forest whose nodes are searched together, and the lower half of a pair of counts.
TOGETHER, WORD = 1 << 17, (1 << 32) - 1
#: Cells of a block of expanded rows, cells that are kept from one Newton step to the next, and tasks from which on each is one job.
BLOCK, KEPT, MANY = 1 << 16, 1 << 22, 48
#: Rows from which on Newton steps start near their end, and columns up to which their products are made once for all fits.
LARGE, NARROW = 1 << 14, 8


def blocks(x: np.ndarray, expand, cells: int):
    """(slice, expanded columns below a row of ones) of blocks of rows, so no task holds all of them."""
    rows = max(1, BLOCK // cells)
    for start in range(0, len(x), rows):
        wide = expand(x[start : start + rows])
        d = np.ones((wide.shape[1] + 1, len(wide)))
        d[1:] = wide.T
        yield slice(start, start + rows), d


def chances(b: np.ndarray, d: np.ndarray) -> np.ndarray:
    e = b.T @ d
    np.clip(e, -30, 30, out=e)
    np.exp(np.negative(e, out=e), out=e)
    e += 1
    return np.reciprocal(e, out=e)


def newton(x: np.ndarray, y: np.ndarray, options: list[tuple[float, bool]], expand, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients, a column for each (c, balanced) from that of b, and their Hessians, by Newton steps of all on the same blocks; each stops by itself."""
    width, m = b.shape
    order = sorted(range(m), key=lambda o: options[o][1])
    ridge = np.repeat([[1 / options[o][0] for o in order]], width, axis=0)
    ridge[0] = 1e-9
    plain = sum(not options[o][1] for o in order)
    w = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1))) if plain < m else None
    b, last = b[:, order], np.empty((m, width, width))
    pairs = list(zip(*np.triu_indices(width)))
    few = width <= NARROW
    cells = width + 3 * m + (len(pairs) if few else width)
    parts = list(blocks(x, expand, cells)) if len(x) * width <= KEPT else None
    going = np.arange(m)
    for _ in range(50):
        now, first = b[:, going], int((going < plain).sum())
        g, h = -ridge[:, going].T * now.T, np.stack([np.diag(r) for r in ridge[:, going].T])
        sums = np.zeros((len(going), len(pairs)))
        for at, d in parts or blocks(x, expand, cells):
            mu = chances(now, d)
            gap, rest = y[at] - mu, mu * (1 - mu)
            if first < len(going):
                gap[first:] *= w[at]
                rest[first:] *= w[at]
            g += gap @ d.T
            if few:
                product = np.empty((len(pairs), d.shape[1]))
                for q, (i, j) in enumerate(pairs):
                    np.multiply(d[i], d[j], out=product[q])
                sums += rest @ product.T
            else:
                for q in range(len(going)):
                    half = d * np.sqrt(rest[q])
                    h[q] += half @ half.T
        if few:
            for q, (i, j) in enumerate(pairs):
                h[:, i, j] += sums[:, q]
                h[:, j, i] = h[:, i, j]
        step = np.linalg.solve(h, g[:, :, None])[:, :, 0]
        size = np.abs(step).max(1)
        b[:, going] += (step * np.minimum(1.0, 10 / np.maximum(size, 1e-12))[:, None]).T
        last[going] = h
        going = going[~(size < 1e-8)]
        if not len(going):
            break
    back = np.argsort(order)
    return b[:, back], last[back]


def coefficients(x: np.ndarray, y: np.ndarray, options: list[tuple[float, bool]], expand) -> np.ndarray:
    """A column of coefficients for each (c, balanced).

    With many rows the weakest penalty starts from the coefficients of every 16th
    row, and the others from its own, a Newton step on with their own penalty,
    for which its Hessian is enough. That saves steps; all steps that count take all rows.
    """
    width, some = expand(x[:1]).shape[1] + 1, y[::16]
    if len(y) < LARGE or min(some.sum(), (1 - some).sum()) < 100:
        return newton(x, y, options, expand, np.zeros((width, len(options))))[0]
    base = [max(o for o in options if o[1] == kind) for kind in sorted({o[1] for o in options})]
    b, h = newton(x, y, base, expand, coefficients(x[::16], some, base, expand))
    of = [[o[1] for o in base].index(o[1]) for o in options]
    start = b[:, of]
    rest = [q for q, o in enumerate(options) if o not in base]
    if rest:
        more = np.repeat([[1 / options[q][0] - 1 / base[of[q]][0]] for q in rest], width, axis=1)
        more[:, 0] = 0
        there = h[[of[q] for q in rest]] + np.stack([np.diag(v) for v in more])
        start[:, rest] -= np.linalg.solve(there, (more * start[:, rest].T)[:, :, None])[:, :, 0].T
        start[:, rest] = newton(x, y, [options[q] for q in rest], expand, start[:, rest])[0]
    return start


def scored(x: np.ndarray, b: np.ndarray, expand) -> np.ndarray:
    """A row of probabilities for each column of coefficients."""
    out = np.empty((b.shape[1], len(x)))
    for at, d in blocks(x, expand, 2 * sum(b.shape)):
        out[:, at] = chances(b, d)
    return out


class Logistic:
    """Logistic regression with a ridge penalty, by Newton steps; expand makes columns of a block of rows."""

    def __init__(self, x, y, c: float = 1.0, balanced: bool = False, expand=None):
        self.expand = expand or (lambda v: v)
        self.b = coefficients(x, y, [(c, balanced)], self.expand)[:, 0]

    def __call__(self, x):
        return scored(x, self.b[:, None], self.expand)[0]

    @staticmethod
    def several(x, y, options: list[dict], held):
        """Predictions for held of each of some parameter sets, which are fitted side by side."""
        same = lambda v: v
        return scored(held, coefficients(x, y, [(o["c"], o["balanced"]) for o in options], same), same)


class Additive:
    """Additive logistic model on quantile bins of each feature: main effects as step functions."""

    def __init__(self, x, y, bins: int = 8):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        self.inner = Logistic(x, y, c=0.5, expand=self.expand)

    def expand(self, x):
        return np.concatenate([np.eye(len(e) + 1)[np.searchsorted(e, c)] for e, c in zip(self.edges, x.T)], axis=1)

    def __call__(self, x):
        return self.inner(x)


class Fourier:
    """Random Fourier features of a Gaussian kernel under a ridge logistic: in place of a kernel machine."""

    def __init__(self, x, y, c: float = 1.0, gamma: float | None = None, balanced: bool = False, size: int = 64):
        self.features(x, gamma, size)
        self.inner = Logistic(x, y, c, balanced, self.expand)

    def features(self, x, gamma: float | None, size: int = 64):
        r = np.random.Generator(np.random.PCG64(11))
        if gamma is None:  # the inverse of the features' number times their variance
            gamma = 1 / max(x.shape[1] * float(x.var()), 1e-12)
        self.w, self.b = r.standard_normal((x.shape[1], size)) * np.sqrt(2 * gamma), r.uniform(0, 2 * np.pi, size)
        self.size = size
        return self

    def expand(self, x):
        return np.cos(x @ self.w + self.b) * np.sqrt(2 / self.size)

    def __call__(self, x):
        return self.inner(x)

    @classmethod
    def several(cls, x, y, options: list[dict], held):
        """Logistic.several() of parameter sets with the same gamma."""
        own = cls.__new__(cls).features(x, options[0]["gamma"])
        return scored(held, coefficients(x, y, [(o["c"], o["balanced"]) for o in options], own.expand), own.expand)


class Forest:
    """Random forest of unpruned Gini trees on bootstrap samples: as many features as the root of their number are tried in a
    node, and more only while none of them varies. Trees grow side by side, a level at a time, some of its nodes at a time."""

    def __init__(self, x, y, depth: int | None = None, leaf: int = 1, balanced: bool = False, trees: int = 300):
        r = np.random.Generator(np.random.PCG64(11))
        one = [len(y) / (2 * max(c.sum(), 1)) if balanced else 1.0 for c in (1 - y, y)]
        values = [np.unique(c) for c in x.T]
        rank = np.column_stack([np.searchsorted(v, c) for v, c in zip(values, x.T)])
        at_once = max(1, 2_000_000 // len(y))
        self.parts = [self.grow(rank, values, y, one, r, min(at_once, trees - t), depth, leaf) for t in range(0, trees, at_once)]
        self.trees = trees

    @staticmethod
    def grow(rank, values, y, one, r, trees, depth, leaf):
        """Entries are a row of a tree and how often it was drawn. A level keeps them by node, as one number each: the node's
        place among those that are searched together, the row's rank, the row, its outcome and its times. So sorting
        these sorts all, and a split is a place in the order. Counts are whole numbers; class weights come to them at the end."""
        n, f = rank.shape
        times = np.bincount((np.arange(trees)[:, None] * n + r.integers(0, n, (trees, n))).ravel(), minlength=trees * n)
        at = np.flatnonzero(times)
        size, own, base = np.bincount(at // n, minlength=trees), np.arange(trees), np.cumsum([0, *map(len, values)])
        few, first, level, out, flat = max(1, int(np.sqrt(f))), 0, 0, [], rank.ravel()
        t, b = int(times.max()).bit_length(), int(n).bit_length()
        entry = (at % n) << (t + 1) | y[at % n].astype(np.int64) << t | times[at]
        seen, together = (1 << (b + t + 1)) - 1, min(TOGETHER, 1 << max(0, 61 - 2 * b - t))
        every = np.concatenate(values)
        while len(size):
            m, start = len(size), np.cumsum(size) - size
            order = np.argsort(r.random((m, f)), axis=1)
            feature, cut, value, left = np.full(m, -1), np.zeros(m), np.empty(m), np.zeros(m, np.int64)
            last = start + size
            low = 0
            while low < m:
                high = max(low + 1, int(np.searchsorted(last, start[low] + together, side="right")))
                span = slice(start[low], last[high - 1])
                here, many = entry[span], size[low:high]
                begin = start[low:high] - start[low]
                c = (here & ((1 << t) - 1)) << 32 * ((here >> t) & 1)
                both = np.add.reduceat(c, begin)
                pos, neg = both >> 32, both & WORD
                ones = np.add.reduceat((here >> t) & 1, begin)
                total = pos * one[1] + neg * one[0]
                value[low:high] = pos * one[1] / total
                wanted = (ones > 0) & (ones < many) & (many >= 2 * leaf) & (depth is None or level < depth)
                best, varies = np.full(high - low, -np.inf), np.zeros(high - low, bool)
                for j in range(f):
                    k = np.flatnonzero(wanted & ((j < few) | ~varies))
                    if not len(k):
                        break
                    length, q = many[k], order[low + k, j]
                    starts = np.cumsum(length) - length
                    where = np.repeat(begin[k] - starts, length) + np.arange(length.sum())
                    some = here[where]
                    number = np.repeat(np.arange(len(k)), length)
                    v = flat[(some >> (t + 1)) * f + np.repeat(q, length)]
                    some = np.sort((number << b | v) << (b + t + 1) | some)
                    v = some >> (b + t + 1)
                    edge = np.flatnonzero(v[1:] != v[:-1])
                    edge = edge[number[edge] == number[edge + 1]]
                    varies[k[number[edge]]] = True
                    before = edge - starts[number[edge]] + 1
                    edge = edge[(before >= leaf) & (length[number[edge]] - before >= leaf)]
                    if not len(edge):
                        continue
                    upto = np.cumsum((some & ((1 << t) - 1)) << 32 * ((some >> t) & 1))
                    of = number[edge]
                    taken = upto[edge] - np.concatenate(([0], upto[starts[1:] - 1]))[of]
                    all_, all_pos = total[k][of], (pos[k] * one[1])[of]
                    p = (taken >> 32) * one[1]
                    a = p + (taken & WORD) * one[0]
                    c, d = all_ - a, all_pos - p
                    score = (p**2 + (a - p) ** 2) / a + (d**2 + (c - d) ** 2) / c
                    group = np.flatnonzero(np.diff(of, prepend=-1))
                    most = np.maximum.reduceat(score, group)
                    top = np.flatnonzero(score == np.repeat(most, np.diff(np.append(group, len(of)))))
                    top = top[np.flatnonzero(np.diff(of[top], prepend=-1))]
                    better = most > best[k[of[top]]]
                    top = top[better]
                    node, place = of[top], edge[top]
                    best[k[node]], feature[low + k[node]] = score[top], q[node]
                    lo, hi = (every[base[q[node]] + (v[place + i] & ((1 << b) - 1))] for i in (0, 1))
                    middle = (lo + hi) / 2
                    cut[low + k[node]] = np.where(middle < hi, middle, lo)
                    left[low + k[node]] = place - starts[node] + 1
                    # The entries of a node stay in the order of its best feature, so its children are a prefix and the rest.
                    new = np.zeros(len(k), bool)
                    new[node] = True
                    new = np.repeat(new, length)
                    here[where[new]] = some[new] & seen
                low = high
            split = feature >= 0
            out.append((feature, cut, np.where(split, first + m + np.cumsum(split) * 2 - 2, 0), value, own))
            entry = entry[np.repeat(split, size)]
            size, own, first = np.column_stack([left, size - left])[split].ravel(), np.repeat(own[split], 2), first + m
            level += 1
        feature, cut, child, value, own = (np.concatenate(c) for c in zip(*out))
        # A tree's nodes stand together.
        order = np.argsort(own, kind="stable")
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        return trees, feature[order], cut[order], place[child[order]], value[order], np.searchsorted(own[order], np.arange(trees))

    def __call__(self, x):
        total, flat, f = np.zeros(len(x)), np.ascontiguousarray(x).ravel(), x.shape[1]
        for _, feature, cut, child, value, roots in self.parts:
            for root in roots:
                row, node = np.arange(len(x)), np.full(len(x), root)
                while len(row):
                    q = feature[node]
                    if (done := q < 0).any():
                        total[row[done]] += value[node[done]]
                        row, node, q = row[~done], node[~done], q[~done]
                    node = child[node] + (flat[row * f + q] > cut[node])
        return total / self.trees


class Boosted:
    """Gradient-boosted trees on histograms of 256 bins at most, with second-order gains of the logistic loss."""

    def __init__(self, x, y, depth: int = 3, rate: float = 0.1, ridge: float = 1.0, rows: float = 0.8, columns: float = 0.8, trees: int = 300, least: float = 1.0):
        r = np.random.Generator(np.random.PCG64(11))
        n, f = x.shape
        mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base, self.depth, self.trees, bins = float(np.log(mean / (1 - mean))), depth, [], 256
        self.edges = [(u[1:] + u[:-1]) / 2 if len(u := np.unique(c)) <= bins else np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = self.bin(x)
        margin = np.full(n, self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            in_ = np.flatnonzero(r.random(n) < rows)
            some = np.sort(r.permutation(f)[: max(1, int(columns * f))])
            g, h, at, node, tree = (p - y)[in_], (p * (1 - p))[in_], b[in_], np.zeros(len(in_), int), []
            for level in range(depth):
                m = 1 << level
                key = ((node[:, None] * len(some) + np.arange(len(some))) * bins + at[:, some]).ravel()
                fill = lambda c: np.bincount(key, np.repeat(c, len(some)), m * len(some) * bins).reshape(m, len(some), bins).cumsum(2)  # noqa: B023, E731
                left_g, left_h = fill(g), fill(h)
                all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
                gain = np.where((left_h >= least) & (right_h >= least), gain, -np.inf).reshape(m, -1)
                best = gain.argmax(1)
                # A node without a gain sends all its rows left.
                cut = np.where(gain[np.arange(m), best] > 1e-6, best % bins, bins)
                tree.append((some[best // bins], cut))
                node = 2 * node + (at[np.arange(len(in_)), tree[-1][0][node]] > cut[node])
            leaf = -rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + ridge)
            self.trees.append((tree, leaf))
            margin += self.one(b, tree, leaf)

    def bin(self, x):
        return np.column_stack([np.searchsorted(e, c) for e, c in zip(self.edges, x.T)])

    @staticmethod
    def one(b, tree, leaf):
        node, every = np.zeros(len(b), int), np.arange(len(b))
        for feature, cut in tree:
            node = 2 * node + (b[every, feature[node]] > cut[node])
        return leaf[node]

    def __call__(self, x):
        b = self.bin(x)
        return 1 / (1 + np.exp(-(self.base + sum(self.one(b, *t) for t in self.trees))))


class ModelSpec(NamedTuple):
    """A model of the zoo: its trainer, the parameter sets of the inner search, its name in reports and what to know of it."""

    make: type
    grid: list[dict]
    label: str
    note: str = ""


MODELS = {
    "dummy": (Prior, [{}]),
    "logreg": (Logistic, [{"c": c, "balanced": b} for c in (0.01, 0.03, 0.1, 0.3, 1.0, 3.0) for b in (False, True)]),
    "additive": (Additive, [{"bins": b} for b in (4, 8)]),
    "random_forest": (Forest, [{"depth": d, "leaf": n, "balanced": b} for d in (3, None) for n in (1, 5) for b in (False, True)]),
    "xgboost": (Boosted, [{"depth": d, "rate": r, "ridge": c} for d in (2, 3) for r in (0.05, 0.1) for c in (1.0, 5.0)]),
    "kernel": (Fourier, [{"c": c, "gamma": g, "balanced": b} for c in (0.1, 1.0, 10.0) for g in (None, 0.01) for b in (False, True)]),
}


LABELS = {
    "dummy": ("Prevalence", "the baseline that any model must beat"), "logreg": ("Logistic regression (L2)", "linear in the log-odds"), "additive": ("Additive logistic model", "main effects only; in place of boosted ones"),
    "random_forest": ("Random forest", "300 trees"), "xgboost": ("Gradient-boosted trees", "shallow trees, 300 rounds"), "kernel": ("Kernel logistic model", "random Fourier features; in place of support vectors"),
}
MODELS = {name: ModelSpec(*spec, *LABELS[name]) for name, spec in MODELS.items()}


def available_models() -> list[str]:
    return list(MODELS)


def unavailable_models() -> dict[str, str]:
    """What has no counterpart here, and why."""
    return {"kernel support vectors": "Spark has linear ones only; `kernel` is a random-feature logistic"}


def isotonic(p: np.ndarray, y: np.ndarray):
    """Pool adjacent violators; returns a step function."""
    order = np.argsort(p, kind="stable")
    total, weight, edge = y[order].astype(float), np.ones(len(y)), p[order]
    for _ in range(16):  # runs that do not rise pool at once; what is left has few blocks and pools one by one
        start = np.flatnonzero(np.diff(total / weight, prepend=-np.inf) > 0)
        if len(start) == len(total):
            break
        total, weight, edge = np.add.reduceat(total, start), np.add.reduceat(weight, start), edge[np.append(start[1:], len(edge)) - 1]
    pooled: list[list[float]] = []
    for t, w, x in zip(total.tolist(), weight.tolist(), edge.tolist()):
        while pooled and pooled[-1][0] * w >= t * pooled[-1][1]:
            before = pooled.pop()
            t, w = t + before[0], w + before[1]
        pooled.append([t, w, x])
    value, edge = [t / w for t, w, _ in pooled], [x for _, _, x in pooled]
    return lambda q: np.interp(q, edge, value)


def calibrator(kind: str, p: np.ndarray, y: np.ndarray):
    """none, sigmoid (two-parameter logistic on the logit) or isotonic."""
    lift = lambda q: np.log(np.clip(q, 1e-6, 1 - 1e-6) / (1 - np.clip(q, 1e-6, 1 - 1e-6)))[:, None]
    if kind == "none" or len(np.unique(y)) < 2:
        return lambda q: q
    if kind == "isotonic":
        return isotonic(p, y)
    fitted = Logistic(lift(p), y, c=1e6)
    return lambda q: fitted(lift(q))


def reach(y: np.ndarray, p: np.ndarray, target: float) -> float:
    """The highest score at which the sensitivity is at least the target."""
    pos = np.sort(p[y == 1])[::-1]
    return float(pos[int(np.ceil(target * len(pos))) - 1]) if len(pos) else 0.5


class Rows(NamedTuple):
    """The rows of a group in the order of the sample; those of a fold under 0 are in none."""

    sample: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    x: np.ndarray


def _rows(columns: dict[str, list[np.ndarray]], features: list[str]) -> Rows:
    """The rows whose columns come in pieces; each column's pieces go when it is there."""
    whole = lambda name: np.concatenate(columns.pop(name))
    sample = whole("sample")
    order = np.argsort(sample, kind="stable")
    sample, x = sample[order], np.empty((len(order), len(features)))
    for j, f in enumerate(features):
        x[:, j] = whole(f)[order]
    return Rows(sample, whole("y")[order].astype(float), whole("fold")[order], x)


def _sorted(part: pa.Table, features: list[str]) -> Rows:
    return _rows({n: [part[n].to_numpy()] for n in ("sample", "y", "fold", *features)}, features)


def _lean(data: DataFrame, features: list[str], *more: str) -> DataFrame:
    """The columns that a trainer needs, none of them wider than that."""
    return data.select(*more, F.col("sample").cast("long").alias("sample"), F.col("y").cast("byte").alias("y"), F.col("fold").cast("short").alias("fold"), *[F.col(f).cast("double").alias(f) for f in features])


#: Lanes of a grid of jobs, or twice the cores if these are more.
LANES = 24


def _lanes(data: DataFrame, features: list[str], jobs: list[tuple], do, schema: str) -> DataFrame:
    """The tables that do() yields of each job, a tuple that ends with its repeat, and the Rows of that repeat.

    A lane is a task that takes the rows of one repeat once and every n-th of its
    jobs, so rows are copied for the cores there are and not for the jobs.
    """
    ship(data.sparkSession)
    spark, lanes, of = data.sparkSession, [], defaultdict(list)
    for job in jobs:
        of[job[-1]].append(job)
    most = max(LANES, 2 * spark.sparkContext.defaultParallelism)
    for repeat, own in sorted(of.items()):
        n = min(len(own), -(-most // len(of)))
        lanes += [(repeat, own[i::n]) for i in range(n)]
    table = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(lanes)], "_lane int, repeat int")
    names = ["sample", "y", "fold", *features]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(lambda: defaultdict(list))
        for batch in batches:
            if batch.num_rows:  # a partition has one lane
                for n in names:
                    held[batch["_lane"][0].as_py()][n].append(np.array(batch[n].to_numpy(zero_copy_only=False)))
        for lane in sorted(held):
            rows = _rows(held.pop(lane), features)
            for job in lanes[lane][1]:
                for found in do(*job, rows):
                    yield from found.to_batches(max_chunksize=10_000)

    rows = _lean(data, features, "repeat").join(F.broadcast(table), "repeat").drop("repeat")
    return rows.repartitionById(len(lanes), F.col("_lane")).mapInArrow(run, schema)  # as many rows as jobs


def together(model: str) -> list[list[int]]:
    """Parameter sets of a model that are fitted side by side."""
    spec, of = MODELS[model], defaultdict(list)
    for o, options in enumerate(spec.grid):
        of[0 if spec.make is Logistic else str(options["gamma"]) if spec.make is Fourier else o].append(o)
    return list(of.values())


def split(rows: Rows, fold: int, inner: int) -> np.ndarray:
    """The inner fold of each training row of an outer fold: dealt in turn, outcome by outcome; -1 for its test rows."""
    train = np.flatnonzero((rows.fold != fold) & (rows.fold >= 0))
    out = np.full(len(rows.y), -1, np.int8)
    out[train[np.argsort(rows.y[train], kind="stable")]] = np.arange(len(train)) % inner
    return out


def tried(rows: Rows, model: str, options: list[int], inner: np.ndarray, i: int) -> list[float]:
    """The AUC on inner fold i of each parameter set, fitted on the others."""
    make, grid = MODELS[model][:2]
    b = inner == i
    x, y, held = rows.x[a := (inner >= 0) & ~b], rows.y[a], rows.y[b]
    scale = Scale(x)
    x, rest = scale.over(x), scale.over(rows.x[b])
    if hasattr(make, "several"):
        return [auc(held, p) for p in make.several(x, y, [grid[o] for o in options], rest)]
    return [auc(held, make(x, y, **grid[o])(rest)) for o in options]


def choice(each: dict[int, list[float]]) -> tuple[int, float]:
    """The parameter set with the greatest mean of its inner AUCs, the first of equal ones, and that mean."""
    mean = {o: round(float(np.mean(finite)), 12) if (finite := [v for v in aucs if v == v]) else 0.0 for o, aucs in each.items()}
    option = min(mean, key=lambda o: (-mean[o], o))
    return option, mean[option]


def chosen(rows: Rows, model: str, fold: int, settings: Settings) -> tuple[int, float | None]:
    """The choice() of an outer fold; without a choice the only set and no score."""
    if len(MODELS[model].grid) == 1:
        return 0, None
    inner, each = split(rows, fold, settings.inner), defaultdict(list)
    for options in together(model):
        for i in range(settings.inner):
            for o, value in zip(options, tried(rows, model, options, inner, i)):
                each[o].append(value)
    return choice(each)


def fitted(rows: Rows, model: str, option: int, a: np.ndarray):
    """The model on rows a, as a function of what is to be scored."""
    x = rows.x[a]
    own = Scale(x)
    made = MODELS[model].make(own.over(x), rows.y[a], **MODELS[model].grid[option])
    return lambda held: made(own(held))


def refitted(rows: Rows, model: str, kind: str, fold: int, option: int, settings: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """The places of an outer fold's test rows, their predictions and the threshold."""
    inner, test = split(rows, fold, settings.inner), np.flatnonzero(rows.fold == fold)
    rest, p, each, train = rows.x[test], np.zeros(len(rows.y)), [], inner >= 0
    for i in range(settings.inner):
        b = inner == i
        predict = fitted(rows, model, option, train & ~b)
        p[b] = predict(rows.x[b])
        if settings.ensemble and kind != "none":
            # A calibrator for each inner split, on the rows that its model has not seen; their mean predicts.
            each.append(calibrator(kind, p[b], rows.y[b])(predict(rest)))
    p, y = p[train], rows.y[train]
    calibrate = calibrator(kind, p, y)
    predicted = np.mean(each, axis=0) if each else calibrate(fitted(rows, model, option, train)(rest))
    return test, predicted, reach(y, calibrate(p), settings.target_sensitivity)


def nested_cv(data: DataFrame, features: list[str], tasks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Prediction table of a task grid (model, calibration, repeat) over data (sample, y, repeat, fold, features).

    Each (model, repeat, outer fold, inner fold, parameter sets that are fitted
    side by side) is one job that gives its inner AUCs; then each (task, outer
    fold) with its best set is one: inner predictions for the threshold and the
    calibrator, then the refitted model on the test rows, or with
    settings.ensemble the mean of the inner models, each with a calibrator of its
    own. From MANY tasks on a task is one job that does both for all its folds.
    All that is learned comes from training rows; a model without a choice of
    parameters has no inner score. A lane holds the rows of one repeat, which a
    single-machine trainer must; larger ones belong to pyspark.ml.
    """
    outer = range(settings.outer)
    grid = sorted((r["model"], r["calibration"], r["repeat"]) for r in tasks.select("model", "calibration", "repeat").collect())  # a task grid of some dozens or hundreds of rows

    def refit(model: str, kind: str, fold: int, option: int, score: float | None, repeat: int, rows: Rows) -> Iterator[pa.Table]:
        test, predicted, cut = refitted(rows, model, kind, fold, option, settings)
        for at in range(0, len(test), 10_000):
            some = slice(at, at + 10_000)
            n = len(test[some])
            same = lambda v, kind: pa.repeat(pa.scalar(v, kind), n)  # noqa: B023, E731
            yield pa.table({
                "model": same(model, pa.string()), "calibration": same(kind, pa.string()), "repeat": same(repeat, pa.int32()), "fold": same(fold, pa.int32()),
                "sample": pa.array(rows.sample[test[some]], pa.int64()), "y": pa.array(rows.y[test[some]], pa.int32(), from_pandas=True), "p": pa.array(predicted[some], pa.float64()),
                "cut": same(cut, pa.float64()), "inner_score": same(score, pa.float64()), "params": same(str(MODELS[model].grid[option]), pa.string()),
            })

    schema = "model string, calibration string, repeat int, fold int, sample long, y int, p double, cut double, inner_score double, params string"
    if len(grid) >= MANY:

        def whole(model, kind, repeat, rows):
            for k in outer:
                yield from refit(model, kind, k, *chosen(rows, model, k, settings), repeat, rows)

        return _lanes(data, features, grid, whole, schema)

    def try_out(model, options, k, i, repeat, rows):
        found = tried(rows, model, options, split(rows, k, settings.inner), i)
        n = len(found)
        yield pa.table({"model": [model] * n, "repeat": pa.array([repeat] * n, pa.int32()), "k": pa.array([k] * n, pa.int32()), "i": pa.array([i] * n, pa.int32()), "option": pa.array(options, pa.int32()), "score": found})

    search = [(m, o, k, i, r) for m, r in sorted({(m, r) for m, _, r in grid if len(MODELS[m].grid) > 1}) for o in together(m) for k in outer for i in range(settings.inner)]
    each: dict[tuple, dict[int, list[float]]] = defaultdict(lambda: defaultdict(list))
    if search:
        found = _lanes(data, features, search, try_out, "model string, repeat int, k int, i int, option int, score double").collect()  # a row a fit
        for r in sorted(found, key=lambda r: (r["option"], r["i"])):
            each[r["model"], r["repeat"], r["k"]][r["option"]].append(r["score"])
    # A repeat without rows has no score and no row here.
    final = [(m, c, k, *(choice(each[m, r, k]) if (m, r, k) in each else (0, None)), r) for m, c, r in grid for k in outer]
    return _lanes(data, features, final, refit, schema)


def _pooled(rows: Rows, model: str, folds, settings: Settings) -> float | None:
    """The AUC of the predictions for all test rows of some outer folds; null with one class only."""
    y, p = [], []
    for k in folds:
        test = rows.fold == k
        y.append(rows.y[test]), p.append(fitted(rows, model, chosen(rows, model, k, settings)[0], ~test & (rows.fold >= 0))(rows.x[test]))
    y, p = np.concatenate(y), np.concatenate(p)
    known = np.isin(y, (0, 1)) & ~np.isnan(p)
    return None if (value := auc(y[known], p[known])) != value else value


def resampled_aucs(data: DataFrame, features: list[str], model: str, draws: int, seed: str, settings: Settings = Settings()) -> DataFrame:
    """(draw, auc): nested cross-validation of each of some resamples of the rows (sample, y, fold, features), all folds pooled.

    Copies of a row share its fold, so no row is on both sides. A resample is
    drawn where it is used: which row, in the order of the sample, stands in a
    sample's place follows from a hash of draw and sample.
    """

    def one(draw: int, _, rows: Rows) -> Iterator[pa.Table]:
        at = (rng.first_words(f"{seed}:{draw}:", rows.sample) / 4294967296.0 * len(rows.y)).astype(np.int64)
        drawn = Rows(rows.sample, rows.y[at], rows.fold[at], rows.x[at])
        yield pa.table({"draw": pa.array([draw], pa.int32()), "auc": pa.array([_pooled(drawn, model, range(settings.outer), settings)], pa.float64())})

    return _lanes(data.withColumn("repeat", F.lit(0)), features, [(d, 0) for d in range(draws)], one, "draw int, auc double")


def saturation(data: DataFrame, features: list[str], model: str, percents: list[int], folds: int, seed: str, settings: Settings = Settings()) -> DataFrame:
    """(percent, repeat, fold, auc) of a test fold when a share of the other rows (sample, y, repeat, fold, features), taken by a hash, trains."""

    def one(percent: int, fold: int, repeat: int, rows: Rows) -> Iterator[pa.Table]:
        taken = rng.first_words(f"{seed}:{repeat}:", rows.sample) / 4294967296.0 * 100 <= percent
        some = rows._replace(fold=np.where(rows.fold == fold, 0, np.where(taken, 1, -1)).astype(np.int8))
        cells = [pa.array([v], pa.int32()) for v in (percent, repeat, fold)]
        yield pa.table([*cells, pa.array([_pooled(some, model, [0], settings)], pa.float64())], names=["percent", "repeat", "fold", "auc"])

    repeats = sorted(r["repeat"] for r in data.select("repeat").distinct().collect())  # a row a repeat
    jobs = [(p, k, r) for r in repeats for p in percents for k in range(folds)]
    return _lanes(data, features, jobs, one, "percent int, repeat int, fold int, auc double")


def permutation_importance(data: DataFrame, features: list[str], shuffles: int = 20) -> DataFrame:
    """(fold, feature, importance): mean drop in AUC of a ridge logistic when a feature's test values are shuffled."""
    ship(data.sparkSession)

    def run(part: pa.Table) -> pa.Table:
        fold, (_, y, folds, x) = part["k"][0].as_py(), _sorted(part, features)
        train, test = folds != fold, folds == fold
        scale = Scale(x[train])
        model = Logistic(scale(x[train]), y[train])
        x, y, r = scale(x[test]), y[test], np.random.Generator(np.random.PCG64(fold))
        whole, out = auc(y, model(x)), []
        for j, name in enumerate(features):
            drops = []
            for _ in range(shuffles):
                z = x.copy()
                z[:, j] = r.permutation(z[:, j])
                drops.append(whole - auc(y, model(z)))
            # For a linear model the mean absolute contribution is known in closed form.
            out.append((fold, name, float(np.mean(drops)), float(np.abs(model.b[j + 1] * (x[:, j] - x[:, j].mean())).mean()), float(model.b[j + 1])))
        kinds = [pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["fold", "feature", "importance", "mean_abs", "coefficient"])

    folds = int(data.agg(F.max("fold")).first()[0]) + 1
    rows = _lean(data, features).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return rows.groupBy("k").applyInArrow(run, "fold int, feature string, importance double, mean_abs double, coefficient double")
