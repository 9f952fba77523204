"""Distribution functions that SQL lacks, for the driver's few final numbers."""

from __future__ import annotations

import math


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Newton steps on the distribution function from a logistic start."""
    if not 0 < p < 1:
        return math.inf if p == 1 else -math.inf if p == 0 else math.nan
    if p > 0.5:
        return -normal_quantile(1 - p)
    z = -math.sqrt(-2 * math.log(p)) if p < 0.02 else math.log(p / (1 - p)) / 1.702
    for _ in range(60):
        step = (normal_cdf(z) - p) * math.sqrt(2 * math.pi) * math.exp(z * z / 2)
        z -= max(-0.5, min(0.5, step))
        if abs(step) < 1e-14:
            break
    return z


def beta_regularized(a: float, b: float, x: float) -> float:
    """I_x(a, b) by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularized(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f, tiny = 1.0, 0.0, 1.0, 1e-300
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def student_sf(t: float, df: float) -> float:
    """P(T > t)."""
    tail = 0.5 * beta_regularized(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def student_quantile(p: float, df: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - student_sf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def gamma_upper(a: float, x: float) -> float:
    """Q(a, x), by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - scale * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    f = d
    for n in range(1, 1000):
        num = -n * (n - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return scale * f


def chi2_sf(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided p of k of n at one half."""
    k = min(k, n - k)
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1))
    return min(1.0, 2 * tail)
