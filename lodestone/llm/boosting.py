"""Small gradient-boosted trees for binary labels, trained on the driver and applied as SQL expressions."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of logistic boosting: nested (feature, threshold, left, right) tuples with floats as leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 8) -> None:
        self.depth, self.least = depth, least
        rate_y = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        self.base = float(np.log(rate_y / (1 - rate_y)))
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1], method="lower")) for c in x.T]
        self.trees = []
        margin = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), depth, rate)
            self.trees.append(tree)
            margin += self._apply(tree, x)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, rate: float) -> object:
        total_g, total_h = g[rows].sum(), h[rows].sum() + 1.0
        best = (1e-6, None, None)
        if depth:
            for f, cuts in enumerate(self.cuts):
                if not len(cuts):
                    continue
                left = x[rows, f][:, None] <= cuts[None, :]
                n, lg, lh = left.sum(0), g[rows] @ left, h[rows] @ left + 1.0
                gain = lg**2 / lh + (total_g - lg) ** 2 / (total_h - lh + 1.0) - total_g**2 / total_h
                gain[(n < self.least) | (len(rows) - n < self.least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, float(cuts[k]))
        _, f, cut = best
        if f is None:
            return float(rate * total_g / total_h)
        left = x[rows, f] <= cut
        return (f, cut, self._grow(x, g, h, rows[left], depth - 1, rate), self._grow(x, g, h, rows[~left], depth - 1, rate))

    def _apply(self, tree: object, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, cut, left, right = tree
        return np.where(x[:, f] <= cut, self._apply(left, x), self._apply(right, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._apply(t, x) for t in self.trees), np.zeros(len(x)))

    def sql(self, features: list[str]) -> str:
        """The margin as an expression of columns."""

        def of(tree: object) -> str:
            if isinstance(tree, float):
                return f"{tree!r}D"
            f, cut, left, right = tree
            return f"(case when {features[f]} <= {cut!r}D then {of(left)} else {of(right)} end)"

        return " + ".join([f"{self.base!r}D", *map(of, self.trees)])
