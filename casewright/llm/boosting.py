"""Small gradient-boosted trees: fitted by the driver, scored by Spark expressions."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let


@dataclass
class Boosted:
    """Trees as nested tuples (feature, cut, low, high) with numbers as leaves, and a calibration."""

    features: list[str]
    base: float = 0.0
    trees: list = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        def walk(node, rows: np.ndarray) -> np.ndarray:
            if not isinstance(node, tuple):
                return np.full(len(rows), node)
            j, cut, low, high = node
            return np.where(rows[:, j] <= cut, walk(low, rows), walk(high, rows))

        return self.base + sum((walk(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def flat(self) -> list[dict]:
        """The trees as complete ones of the greatest depth: features and cuts by level, then leaves from low to high."""
        deep = lambda n: 1 + max(deep(n[2]), deep(n[3])) if isinstance(n, tuple) else 0
        depth = max(map(deep, self.trees), default=0)
        out = []
        for tree in self.trees:
            row, f, c = [tree], [], []
            for _ in range(depth):
                f += [n[0] if isinstance(n, tuple) else 0 for n in row]
                c += [float(n[1]) if isinstance(n, tuple) else 0.0 for n in row]
                row = [x for n in row for x in ((n[2], n[3]) if isinstance(n, tuple) else (n, n))]
            out.append({"f": f, "c": c, "v": [float(x) for x in row], "d": depth})
        return out

    def column(self, values: dict[str, Column]) -> Column:
        """The calibrated probability as an expression; each of the features' columns is worked out once.

        The trees are a constant array that is gone through, so the expression is
        as large for many trees as for one.
        """
        trees = self.flat()
        depth = trees[0]["d"] if trees else 0
        literal = F.from_json(F.lit(json.dumps(trees)), "array<struct<f:array<int>,c:array<double>,v:array<double>>>")

        def leaf(t: Column, x: Column) -> Column:
            at = F.lit(0)
            for _ in range(depth):  # of node i the children are 2 i + 1 and 2 i + 2
                at = let(at, lambda i: i * 2 + F.when(F.get(x, F.get(t["f"], i)) <= F.get(t["c"], i), 1).otherwise(2))
            return F.get(t["v"], at - F.lit(2**depth - 1))

        def scored(x: Column) -> Column:
            score = F.aggregate(literal, F.lit(float(self.base)), lambda acc, t: acc + leaf(t, x))
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-(score * F.lit(float(self.slope)) + F.lit(float(self.shift)))))

        return let(F.array(*[values[f] for f in self.features]), scored)


def fit(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray, features: list[str], trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 5) -> Boosted:
    """Newton boosting of the logistic loss; the held-out rows calibrate the probabilities."""
    tx, ty = x, y.astype(float)
    p0 = min(max(ty.mean(), 1e-3), 1 - 1e-3)
    model = Boosted(features, math.log(p0 / (1 - p0)))
    score = np.full(len(ty), model.base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        leaf = rate * g[rows].sum() / (h[rows].sum() + 1.0)
        if not left or len(rows) < 2 * least:
            return float(leaf)
        best, parent = (1e-6, None, None), g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for j in range(tx.shape[1]):
            order = rows[np.argsort(tx[rows, j], kind="stable")]
            v, gs, hs = tx[order, j], np.cumsum(g[order]), np.cumsum(h[order])
            cuts = np.flatnonzero((v[1:] > v[:-1]) & (np.arange(1, len(v)) >= least) & (len(v) - np.arange(1, len(v)) >= least))
            if len(cuts):
                gain = gs[cuts] ** 2 / (hs[cuts] + 1.0) + (gs[-1] - gs[cuts]) ** 2 / (hs[-1] - hs[cuts] + 1.0) - parent
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
        if best[1] is None:
            return float(leaf)
        low = tx[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(ty)), ty - p, p * (1 - p), depth)
        model.trees.append(tree)
        score += Boosted(features, trees=[tree]).raw(tx)
    # Platt's calibration on the held-out rows, with his smoothed targets
    s, t = model.raw(held_x), held_y.astype(float)
    n1, n0 = t.sum(), len(t) - t.sum()
    t = np.where(t > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * s + b)))
        w = p * (1 - p) + 1e-6
        g = np.array([((t - p) * s).sum(), (t - p).sum()])
        hess = np.array([[(w * s * s).sum(), (w * s).sum()], [(w * s).sum(), w.sum()]]) + 1e-3 * np.eye(2)
        da, db = np.linalg.solve(hess, g)
        a, b = a + da, b + db
    model.slope, model.shift = float(a), float(b)
    return model


def threshold(model: Boosted, x: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability from which these candidates, which the model hasn't seen, are right with `precision`."""
    p = model.probability(x)
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((right >= precision) & np.append(p[order][1:] < p[order][:-1], True))
    return max(0.5, float(p[order][good[-1]])) if len(good) else 1.01
