"""Exact tests on counts, as batches."""

from __future__ import annotations

from math import ceil, comb, erfc, exp, lgamma, log, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Counts up to which sums are those of whole numbers; beyond it they are sums of logarithms' exponentials.
WHOLE = 2000
#: Two weights whose logarithms differ by less are compared as fractions.
NEAR = 1e-6


def _product(values: list[int]) -> int:
    """The product, of halves, so that the factors stay of like size."""
    while len(values) > 1:
        values = [a * b for a, b in zip(values[::2], values[1::2] + [1] * (len(values) % 2), strict=True)]
    return values[0] if values else 1


def mcnemar(b: int, c: int) -> float:
    """Two-sided exact probability of discordant counts b and c: of both tails, each a half to the smaller count."""
    n, k = b + c, min(b, c)
    if n <= WHOLE:
        return min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
    # the tail's largest term and the ones below it, of which only those within many deviations count
    i = np.arange(k, max(0, k - int(25 * sqrt(n)) - 60), -1, dtype=float)
    steps = np.cumsum(np.log(i) - np.log(n - i + 1))
    log_first = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * log(2)
    return float(min(1.0, 2 * exp(log_first) * (1 + np.exp(steps).sum())))


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact probability of a 2 by 2 table: of all tables with its margins that are no likelier."""
    r, s, m = a + b, c + d, a + c
    low, high = max(0, m - s), min(r, m)
    if r + s <= WHOLE:
        weights = [comb(r, x) * comb(s, m - x) for x in range(low, high + 1)]
        own = weights[a - low] * (10**12 + 1)
        return min(1.0, sum(w for w in weights if w * 10**12 <= own) / sum(weights))
    mode = min(high, max(low, (r + 1) * (m + 1) // (r + s + 2)))
    wide = int(45 * sqrt(r * s * m / (r + s) ** 2 + 1)) + 60
    first, last = max(low, min(mode, a) - wide), min(high, max(mode, a) + wide)
    x = np.arange(first, last, dtype=float)
    # logarithms of the weights, each from the one before, and 0 at the mode
    logs = np.r_[0, np.cumsum(np.log(r - x) + np.log(m - x) - np.log(x + 1) - np.log(s - m + x + 1))]
    logs -= logs[mode - first]
    apart = logs - logs[a - first]
    counts = apart <= 0
    for i in np.flatnonzero(np.abs(apart) < NEAR).tolist():
        counts[i] = _no_likelier(first + i, a, r, s, m)
    each = np.exp(logs)
    return float(min(1.0, each[counts].sum() / each.sum()))


def _no_likelier(x: int, a: int, r: int, s: int, m: int) -> bool:
    """Whether the table with x has at most the weight of the one with a, and a share of it that is lost in rounding."""
    lo, hi = min(x, a), max(x, a)
    up = _product([(r - i) * (m - i) for i in range(lo, hi)])
    down = _product([(i + 1) * (s - m + i + 1) for i in range(lo, hi)])
    more, less = (up, down) if x > a else (down, up)
    return more * 10**12 <= less * (10**12 + 1)


def two_proportions(x1: int, n1: int, x2: int, n2: int) -> float:
    """Two-sided normal probability that two shares are equal; 1 where it can't be told."""
    if not n1 or not n2 or (x1 + x2) in (0, n1 + n2):
        return 1.0
    p = (x1 + x2) / (n1 + n2)
    z = (x1 / n1 - x2 / n2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    return erfc(abs(z) / sqrt(2))


def _over(test, *counts: Column) -> Column:
    @F.pandas_udf("double")
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(x) for x in row) else test(*map(int, row)) for row in zip(*cols, strict=True)], dtype="float64")

    return run(*counts)


def mcnemar_p(b: Column, c: Column) -> Column:
    return _over(mcnemar, b, c)


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    return _over(fisher, a, b, c, d)


def two_proportions_p(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    return _over(two_proportions, x1, n1, x2, n2)


def paired_power(n: int, delta: float, discordance: float, alpha: float = 0.05) -> float:
    """Power of a two-sided test of a paired difference in n pairs, by the normal approximation."""
    if n < 1 or not 0 < alpha < 1 or not 0 < discordance <= 1 or abs(delta) > discordance:
        raise ValueError("n above 0, alpha and discordance in (0, 1], delta within discordance")
    normal = NormalDist()
    edge, mean = normal.inv_cdf(1 - alpha / 2), abs(delta) * sqrt(n / discordance)
    spread = sqrt(max(0.0, 1 - delta * delta / discordance))
    if not spread:
        return float(mean > edge)
    return min(1.0, max(0.0, normal.cdf((mean - edge) / spread) + normal.cdf((-edge - mean) / spread)))


def _first(holds, low, high, halve, done):
    """The smallest value of the range from which on holds is true, by halving until done."""
    while not done(low, high):
        middle = halve(low, high)
        if holds(middle):
            high = middle
        else:
            low = middle + 1 if isinstance(middle, int) else middle
    return high


def required_pairs(delta: float, discordance: float, power: float, alpha: float = 0.05, most: int = 100_000) -> int | None:
    """The fewest pairs that reach the power; None if `most` don't."""
    enough = lambda n: paired_power(n, delta, discordance, alpha) >= power
    return _first(enough, 1, most, lambda a, b: (a + b) // 2, lambda a, b: a >= b) if enough(most) else None


def detectable_effect(n: int, discordance: float, power: float, alpha: float = 0.05) -> float | None:
    """The smallest difference that n pairs show with the power; None if they show none."""
    enough = lambda d: paired_power(n, d, discordance, alpha) >= power
    return _first(enough, 0.0, discordance, lambda a, b: (a + b) / 2, lambda a, b: b - a < 1e-15) if enough(discordance) else None


def power_plan(spark, discordances: tuple[float, ...], deltas: tuple[float, ...], inflation: float, alpha: float = 0.05):
    """A row for each discordance and each delta within it: pairs for a power of 0.8 and of 0.9, and these inflated for
    clusters. The grid is that of the arguments."""
    rows = []
    for q in discordances:
        for d in (d for d in deltas if d <= q):
            a, b = (required_pairs(d, q, p, alpha) for p in (0.8, 0.9))
            rows.append((q, d, a, a and ceil(a * inflation), b, b and ceil(b * inflation)))
    return spark.createDataFrame(rows, "discordance double, delta double, pairs_80 long, inflated_80 long, pairs_90 long, inflated_90 long")
