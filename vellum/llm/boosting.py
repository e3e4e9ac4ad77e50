"""Gradient-boosted trees over yes/no features, small enough to become one SQL expression."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Tree:
    """A split on a feature, or a leaf's value."""

    feature: int = -1
    value: float = 0.0
    no: Tree | None = None
    yes: Tree | None = None

    def score(self, x: tuple[int, ...]) -> float:
        if self.feature < 0:
            return self.value
        return (self.yes if x[self.feature] else self.no).score(x)

    def column(self, names: list[str]) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(F.col(names[self.feature]), self.yes.column(names)).otherwise(self.no.column(names))

    def of(self, features: Column, names: list[str]) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(features[names[self.feature]], self.yes.of(features, names)).otherwise(self.no.of(features, names))


@dataclass
class BoostedTrees:
    """Log-loss boosting with Newton leaves on rows weighted by how often their features occur."""

    rounds: int = 20
    depth: int = 3
    rate: float = 0.3
    l2: float = 1.0
    trees: list[Tree] = field(default_factory=list)
    bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)

    def fit(self, rows: list[tuple[tuple[int, ...], float, float]]) -> BoostedTrees:
        """rows: (features, positives, negatives), one for each distinct vector of features."""
        pos, neg = sum(p for _, p, _ in rows), sum(n for *_, n in rows)
        self.bias = math.log((pos + 1) / (neg + 1))
        margin = [self.bias] * len(rows)
        for _ in range(self.rounds):
            gradients = []
            for (_, p, n), m in zip(rows, margin, strict=True):
                q = 1 / (1 + math.exp(-m))
                gradients.append((p - (p + n) * q, (p + n) * q * (1 - q)))
            tree = self._grow(rows, gradients, list(range(len(rows))), self.depth)
            self.trees.append(tree)
            margin = [m + tree.score(x) for (x, *_), m in zip(rows, margin, strict=True)]
        return self

    def _grow(self, rows: list, gradients: list, some: list[int], depth: int) -> Tree:
        g, h = (sum(gradients[i][k] for i in some) for k in (0, 1))
        best, at = 1e-9, -1
        gain = lambda a, b: a * a / (b + self.l2)
        for f in range(len(rows[0][0])) if depth else ():
            yes = [i for i in some if rows[i][0][f]]
            if 0 < len(yes) < len(some):
                a, b = sum(gradients[i][0] for i in yes), sum(gradients[i][1] for i in yes)
                won = gain(a, b) + gain(g - a, h - b) - gain(g, h)
                if won > best:
                    best, at = won, f
        if at < 0:
            return Tree(value=self.rate * g / (h + self.l2))
        no, yes = ([i for i in some if bool(rows[i][0][at]) == side] for side in (False, True))
        return Tree(at, 0.0, self._grow(rows, gradients, no, depth - 1), self._grow(rows, gradients, yes, depth - 1))

    def margin(self, x: tuple[int, ...]) -> float:
        return self.bias + sum(t.score(x) for t in self.trees)

    def calibrate(self, rows: list[tuple[tuple[int, ...], float, float]]) -> BoostedTrees:
        """Platt scaling on rows that fit() didn't see, by Newton steps."""
        a, b = 1.0, 0.0
        data = [(self.margin(x), p, n) for x, p, n in rows]
        for _ in range(30):
            g0 = g1 = h00 = h01 = h11 = 0.0
            for m, p, n in data:
                q = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * m + b))))
                d, w = p - (p + n) * q, (p + n) * q * (1 - q)
                g0, g1 = g0 + d * m, g1 + d
                h00, h01, h11 = h00 + w * m * m, h01 + w * m, h11 + w
            h00, h11 = h00 + 1e-2, h11 + 1e-2
            g0, g1 = g0 - 1e-2 * (a - 1), g1 - 1e-2 * b
            det = h00 * h11 - h01 * h01
            if det <= 1e-12:
                break
            a, b = a + (h11 * g0 - h01 * g1) / det, b + (h00 * g1 - h01 * g0) / det
        self.scale = (a, b)
        return self

    def probability(self, x: tuple[int, ...]) -> float:
        a, b = self.scale
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * self.margin(x) + b))))

    def threshold(self, rows: list[tuple[tuple[int, ...], float, float]], precision: float) -> float:
        """The least probability from which on the rows have the precision asked for; 1.1 if none does."""
        ranked = sorted(((self.probability(x), p, n) for x, p, n in rows), reverse=True)
        cut, hits, misses = 1.1, 0.0, 0.0
        for i, (q, p, n) in enumerate(ranked):
            hits, misses = hits + p, misses + n
            if (i + 1 == len(ranked) or ranked[i + 1][0] < q) and hits >= precision * (hits + misses):
                cut = q
        return cut

    def column(self, features: Column, names: list[str]) -> Column:
        """The probability in SQL, from a struct of booleans."""
        margin = F.lit(self.bias)
        for t in self.trees:
            margin = margin + t.of(features, names)
        a, b = self.scale
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(a) * margin + F.lit(b)))))
