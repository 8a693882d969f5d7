"""Gradient-boosted trees over small tables of distinct feature vectors, applied as SQL expressions.

Features are small integers, so a whole corpus shrinks to a bounded table of (features, label, count).  Trees are fitted to
that table, which holds all rows of the corpus and not a sample, and become CASE expressions that Spark compiles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass
class Tree:
    """A split ``feature <= at`` with two sides, or a leaf."""

    value: float = 0.0
    feature: str = ""
    at: int = 0
    low: "Tree | None" = None
    high: "Tree | None" = None

    def of(self, x: dict) -> float:
        if self.low is None:
            return self.value
        return (self.low if x[self.feature] <= self.at else self.high).of(x)

    def sql(self, prefix: str = "") -> str:
        if self.low is None:
            return f"{self.value!r}D"
        return f"CASE WHEN {prefix}{self.feature} <= {self.at} THEN {self.low.sql(prefix)} ELSE {self.high.sql(prefix)} END"


@dataclass
class Boosted:
    start: float
    trees: list[Tree] = field(default_factory=list)

    def score(self, x: dict) -> float:
        return 1 / (1 + math.exp(-(self.start + sum(t.of(x) for t in self.trees))))

    def sql(self, prefix: str = "") -> str:
        return f"1 / (1 + exp(-({self.start!r}D" + "".join(f" + {t.sql(prefix)}" for t in self.trees) + ")))"


def _grow(rows: list, names: list[str], depth: int, rate: float, ridge: float, least: float) -> Tree:
    """rows: (features, gradient, curvature)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = (1e-9, None, 0)
    if depth:
        for name in names:
            by: dict[int, list[float]] = {}
            for x, gr, hr in rows:
                s = by.setdefault(x[name], [0.0, 0.0])
                s[0] += gr
                s[1] += hr
            lg = lh = 0.0
            for at in sorted(by)[:-1]:
                lg, lh = lg + by[at][0], lh + by[at][1]
                if min(lh, h - lh) < least:
                    continue
                gain = lg * lg / (lh + ridge) + (g - lg) ** 2 / (h - lh + ridge) - g * g / (h + ridge)
                if gain > best[0] + 1e-12:  # ties go to the first feature and the lowest split
                    best = (gain, name, at)
    if best[1] is None:
        return Tree(value=round(rate * g / (h + ridge), 9))
    _, name, at = best
    sides = [[r for r in rows if (r[0][name] <= at) == low] for low in (True, False)]
    return Tree(0.0, name, at, *(_grow(s, names, depth - 1, rate, ridge, least) for s in sides))


def fit(table: list[tuple[dict, int, float]], names: list[str], trees: int = 30, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: float = 0.5) -> Boosted:
    """Logistic boosting of a table of (features, label, count)."""
    table = sorted(table, key=lambda r: ([r[0][n] for n in names], r[1]))
    total, ones = sum(r[2] for r in table), sum(r[2] for r in table if r[1])
    p = min(max(ones / total if total else 0.5, 1e-4), 1 - 1e-4)
    model = Boosted(round(math.log(p / (1 - p)), 9))
    at = [model.start] * len(table)
    for _ in range(trees if 0 < ones < total else 0):
        rows = []
        for (x, y, n), s in zip(table, at):
            q = 1 / (1 + math.exp(-s))
            rows.append((x, n * (y - q), n * q * (1 - q)))
        tree = _grow(rows, names, depth, rate, ridge, least)
        model.trees.append(tree)
        at = [s + tree.of(x) for (x, _, _), s in zip(table, at)]
    return model


def threshold(scored: list[tuple[float, int, float]], precision: float, otherwise: float = 0.9) -> float:
    """The lowest score from which on the rows (score, label, count) reach the precision; ``otherwise`` if none does."""
    good = all_ = 0.0
    best, rows = otherwise, sorted(scored, reverse=True)
    for i, (s, y, n) in enumerate(rows):
        good, all_ = good + n * y, all_ + n
        if (i + 1 == len(rows) or rows[i + 1][0] < s) and good >= precision * all_:
            best = s
    return best
