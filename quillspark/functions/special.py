"""Special functions in numpy and plain Python: tails of F, t, chi-square and hypergeometric laws in log space."""

from __future__ import annotations

import math

import numpy as np


def log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 10_000):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + n * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + n / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return out
    return out


def log_incomplete_beta(a: float, b: float, x: float) -> float:
    """log I_x(a, b), the regularised incomplete beta function."""
    if x <= 0:
        return -math.inf
    if x >= 1:
        return 0.0
    front = a * math.log(x) + b * math.log1p(-x) - log_beta(a, b)
    if x < (a + 1) / (a + b + 2):
        return front + math.log(_beta_fraction(a, b, x) / a)
    other = front + math.log(_beta_fraction(b, a, 1 - x) / b)
    return math.log(-math.expm1(other)) if other < 0 else -math.inf


def f_log_tail(f: float, d1: float, d2: float) -> float:
    """log P(F > f)."""
    if not f > 0:
        return 0.0
    return log_incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    if math.isnan(t):
        return math.nan
    return math.exp(log_incomplete_beta(df / 2, 0.5, df / (df + t * t)))


def chi2_log10_tail(x: float, k: int) -> float:
    """log10 of the chi-square tail with 2k degrees of freedom: a finite sum; its leading term alone below 1e-308."""
    half = x / 2
    if k <= 0:
        return math.nan
    if half <= 0:
        return 0.0
    terms = [i * math.log(half) - math.lgamma(i + 1) for i in range(k)]
    top = max(terms)
    exact = (-half + top + math.log(sum(math.exp(t - top) for t in terms))) / math.log(10)
    if exact >= -308:
        return exact
    return (-half + (k - 1) * math.log(half) - math.lgamma(k)) / math.log(10)


def fisher_exact_greater(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """Sample odds ratio and one-sided p of a 2x2 table [[a, b], [c, d]] for more in a."""
    odds = math.nan if (a * d == 0 and b * c == 0) else math.inf if b * c == 0 else a * d / (b * c)
    row, col, n = a + b, a + c, a + b + c + d
    k = np.arange(a, min(row, col) + 1)
    logs = np.array([math.lgamma(row + 1) - math.lgamma(i + 1) - math.lgamma(row - i + 1) + math.lgamma(n - row + 1) - math.lgamma(col - i + 1) - math.lgamma(n - row - col + i + 1) for i in k.tolist()])
    total = math.lgamma(n + 1) - math.lgamma(col + 1) - math.lgamma(n - col + 1)
    if not len(logs):
        return odds, 0.0
    top = logs.max()
    return odds, float(min(1.0, math.exp(top - total) * np.exp(logs - top).sum()))
