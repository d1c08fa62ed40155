"""Student t and normal distribution functions, and the design arithmetic built on them."""

from __future__ import annotations

import math

import numpy as np

from poolstat.errors import check

# The error-function and normal-quantile approximations whose digits results are compared by.
ERF = [1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592, 0.0]
ERF_P = 0.3275911
Z_CENTRE = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
Z_CENTRE_UNDER = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
Z_TAIL = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
Z_TAIL_UNDER = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
Z_TAIL_FROM = 0.02425
F_975_12_12 = 3.277
Z_975, Z_HOLM_WORST = 1.959964, 2.575829


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its hypergeometric series, from the side where it converges fast."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x * (a + b + 2) > a + 1:
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    total = term = 1.0
    n = 0
    while term > total * 1e-17:
        term *= x * (a + b + n) / (a + 1 + n)
        total += term
        n += 1
    return front * total


def t_two_sided(t: float, df: float) -> float:
    check(df > 0, f"degrees of freedom must be positive, got {df}")
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_cdf(t: float, df: float) -> float:
    tail = t_two_sided(t, df) / 2
    return 1 - tail if t >= 0 else tail


def t_upper_tail(t: float, df: float) -> float:
    return t_cdf(-t, df)


def t_quantile(p: float, df: float) -> float:
    """Inverse of t_cdf by bisection on a doubled bracket."""
    check(0 < p < 1, f"p must lie inside (0, 1), got {p}")
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while t_cdf(high, df) < p:
        low, high = high, high * 2
    while high - low > 1e-12 * max(1.0, high):
        middle = (low + high) / 2
        low, high = (middle, high) if t_cdf(middle, df) < p else (low, middle)
    return 0.0 if p == 0.5 else (low + high) / 2


def normal_cdf(x: float) -> float:
    """By the five-term rational error function."""
    z = abs(x) / math.sqrt(2)
    tail = float(np.polyval(ERF, 1 / (1 + ERF_P * z))) * math.exp(-z * z)
    return 0.5 * (1 + math.copysign(1 - tail, x))


def normal_quantile(p: float) -> float:
    check(0 < p < 1, f"p must lie inside (0, 1), got {p}")
    if p > 1 - Z_TAIL_FROM:
        return -normal_quantile(1 - p)
    if p < Z_TAIL_FROM:
        q = math.sqrt(-2 * math.log(p))
        return float(np.polyval(Z_TAIL, q) / np.polyval(Z_TAIL_UNDER, q))
    q = p - 0.5
    return float(q * np.polyval(Z_CENTRE, q * q) / np.polyval(Z_CENTRE_UNDER, q * q))


def upper_tail(z: float, df: float | None) -> float:
    """One-sided p: t where the fit carries degrees of freedom, else normal."""
    return t_upper_tail(z, df) if df else 1 - normal_cdf(z)


def contrast_se(brief_arm: float, residual: float, briefs: int, replicates: int) -> float:
    """Standard error of a two-arm contrast over briefs x replicates cells."""
    return math.sqrt(2 * (brief_arm / briefs + residual / (briefs * replicates)))
