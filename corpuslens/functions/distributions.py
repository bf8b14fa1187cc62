"""Tails of the distributions that the tests need, for one row per test.

Data-sized work is done by aggregates; these functions see a few numbers per
test.  They are used on result tables of a few rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import functions as F


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    """P(X >= x) for chi-square."""
    return 1.0 if x <= 0 or df <= 0 else _gamma_q(df / 2, x / 2)


def _beta_cf(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 10_000):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + an * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + an / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 else 1.0


def spearman_p(rho: float, n: float) -> float:
    """Two-sided p of a rank correlation by the t distribution with n - 2 degrees of freedom."""
    if n < 3 or math.isnan(rho):
        return 1.0
    return 0.0 if abs(rho) >= 1 else t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def _tail(logp: Callable[[int], float], start: int, end: int, step: int) -> float:
    """Sum of exp(logp) from start towards end, away from the mode, until terms vanish."""
    total, k = 0.0, start
    while (end - k) * step >= 0:
        term = math.exp(logp(k))
        total += term
        if term < total * 1e-17:
            break
        k += step
    return total


def fisher_two_sided(a: float, b: float, c: float, d: float) -> float:
    """Two-sided exact p of a 2x2 table: the tables at most as likely as this one.

    Likelihood falls on both sides of the mode, so these are two tails; where
    the far one begins is found by bisection, and a tail is summed until its
    terms vanish, which takes a number of steps in the order of the standard
    deviation whatever the margins.
    """
    a, b, c, d = int(a), int(b), int(c), int(d)
    row, col, n = a + b, a + c, a + b + c + d
    lf = lambda x: math.lgamma(x + 1)
    base = lf(row) + lf(n - row) + lf(col) + lf(n - col) - lf(n)
    logp = lambda k: base - lf(k) - lf(row - k) - lf(col - k) - lf(n - row - col + k)
    least, most = max(0, row + col - n), min(row, col)
    mode = min(most, max(least, (row + 1) * (col + 1) // (n + 2)))
    here = logp(a) + 1e-7

    def outer(end: int, step: int) -> int:
        """The value nearest to the mode on this side that is at most as likely; beyond `end` if there is none."""
        lo, hi = 0, (end - mode) * step + 1
        while lo < hi:
            mid = (lo + hi) // 2
            if mid > (end - mode) * step or logp(mode + mid * step) <= here:
                hi = mid
            else:
                lo = mid + 1
        return mode + lo * step

    low, high = outer(least, -1), outer(most, 1)
    if low == high == mode:
        return 1.0
    return min(1.0, _tail(logp, low, least, -1) + _tail(logp, high, most, 1))


def probit(p: float) -> float:
    return NormalDist().inv_cdf(p)


def column(f: Callable[..., float]):
    """f as a UDF on columns of doubles, for result tables of a few rows; null where an argument is null."""
    return F.udf(lambda *xs: None if any(x is None or x != x for x in xs) else float(f(*xs)), "double")
