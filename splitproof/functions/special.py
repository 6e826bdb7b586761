"""Distribution functions without SciPy: regularised incomplete beta, Student t, normal, exact Wilcoxon."""

from __future__ import annotations

import itertools
import math


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + term * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + term / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1) / a


def beta_ppf(a: float, b: float, q: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_inc(a, b, mid) < q else (low, mid)
    return (low + high) / 2


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def t_ppf(q: float, df: float) -> float:
    """Upper quantile for q > 1/2."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < q else (low, mid)
    return (low + high) / 2


def wilcoxon_exact(differences: list[float]) -> tuple[float, float]:
    """(W = smaller rank sum, two-sided p by all sign patterns); NaN where every difference is zero."""
    d = sorted((x for x in differences if x), key=abs)
    n = len(d)
    if not n:
        return math.nan, math.nan
    size = [abs(x) for x in d]
    ranks = [sum(i + 1 for i in range(n) if size[i] == s) / size.count(s) for s in size]
    plus = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
    total = sum(ranks)
    w = min(plus, total - plus)
    if n > 20:
        z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
        return w, math.erfc(abs(z) / math.sqrt(2))
    at_most = sum(1 for signs in itertools.product((0, 1), repeat=n) if sum(r for r, s in zip(ranks, signs, strict=True) if s) <= w + 1e-9)
    return w, min(1.0, 2 * at_most / 2**n)
