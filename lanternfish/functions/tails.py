"""Tails of distributions for p-values: a few numbers in, one number out, on the one-row results of the tests."""

from __future__ import annotations

import math

import numpy as np


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 100_000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return max(0.0, 1 - scale * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi_square_p(chi2: float | None, dof: int) -> float | None:
    return None if chi2 is None or dof < 1 else gamma_tail(dof / 2, chi2 / 2)


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def student_p(t: float, dof: float) -> float:
    """Two-sided."""
    return beta_share(dof / 2, 0.5, dof / (dof + t * t))


def rank_sum_counts(m: int, n: int) -> np.ndarray:
    """Number of ways, of all choices of m among m + n ranks, in which U takes each value from 0 to m n."""
    m, n = min(m, n), max(m, n)
    ways = np.zeros(m * n + 1)
    ways[0] = 1
    for i in range(1, m + 1):  # times (1 - x^(n + i)) / (1 - x^i)
        ways[n + i :] -= ways[: max(0, len(ways) - n - i)].copy()
        for r in range(i):
            ways[r::i] = np.cumsum(ways[r::i])
    return ways


def rank_sum_p(u: float, n_a: int, n_b: int, ties: float) -> float:
    """Two-sided p-value of U: exact if a side has eight values or fewer and none are equal, else by the normal distribution
    with corrections for ties and continuity.  ``ties`` is the sum of t^3 - t over groups of t equal values."""
    high = max(u, n_a * n_b - u)
    if ties == 0 and min(n_a, n_b) <= 8:
        ways = rank_sum_counts(n_a, n_b)
        return float(min(1.0, 2 * ways[math.ceil(high) :].sum() / ways.sum()))
    n = n_a + n_b
    spread = math.sqrt(n_a * n_b / 12 * (n + 1 - ties / (n * (n - 1))))
    return 1.0 if spread == 0 else min(1.0, normal_p(max(0.0, (high - n_a * n_b / 2 - 0.5) / spread)))
