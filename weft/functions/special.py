"""Numeric kernels over small arrays: distribution tails, binomials, k-means, scaling."""

from __future__ import annotations

import math

import numpy as np

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def log_choose(n, k) -> np.ndarray:
    n, k = np.asarray(n, float), np.asarray(k, float)
    return _LGAMMA(n + 1) - _LGAMMA(k + 1) - _LGAMMA(n - k + 1)


def digamma(x) -> np.ndarray:
    """The derivative of the logarithm of the gamma function, of numbers over 0."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        if not low.any():
            break
        out -= np.where(low, 1 / x, 0.0)
        x = x + low
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def log_gamma(x) -> np.ndarray:
    """The logarithm of the gamma function, of numbers over 0."""
    x = np.array(x, float)
    below = np.ones_like(x)
    for _ in range(8):
        low = x < 8
        if not low.any():
            break
        below *= np.where(low, x, 1.0)
        x = x + low
    y = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x - np.log(below)


def beta_part(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_part(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    f = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or 1e-300)
            c = (1 + top / c) or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 2000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    f = d
    for n in range(1, 2000):
        top = -n * (n - a)
        b += 2
        d = 1 / ((top * d + b) or 1e-300)
        c = (b + top / c) or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return f * math.exp(-x + a * math.log(x) - math.lgamma(a))


def t_two_sided(t: float, df: float) -> float:
    return beta_part(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_part(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def classical_mds(distance: np.ndarray, dims: int = 2) -> np.ndarray:
    """Points whose distances come near the given ones."""
    n = len(distance)
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ distance**2 @ centre)
    top = np.argsort(values)[::-1][:dims]
    out = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
    signs = np.sign(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])])
    return np.pad(out * np.where(signs == 0, 1, signs), ((0, 0), (0, max(0, dims - out.shape[1]))))
