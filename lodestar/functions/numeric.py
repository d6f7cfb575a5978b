"""Special functions over NumPy arrays, and the column functions that are made of them."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Lanczos coefficients for g = 7.
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0."""
    x = np.asarray(x, float)
    small = x < 0.5
    z = np.where(small, 1 - x, x) - 1
    a = np.full_like(z, _LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        a = a + c / (z + k)
    t = z + 7.5
    out = 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(a)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(small, np.log(np.pi / np.abs(np.sin(np.pi * x))) - out, out)


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log_gamma for x > 0, by recurrence up to 6 and the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out = np.where(low, out - 1 / x, out)
        x = np.where(low, x + 1, x)
    inv = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv * (1 / 240 - inv / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    """Second derivative of log_gamma for x > 0."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out = np.where(low, out + 1 / (x * x), out)
        x = np.where(low, x + 1, x)
    inv = 1 / (x * x)
    return out + 1 / x + inv / 2 + inv / x * (1 / 6 - inv * (1 / 30 - inv * (1 / 42 - inv / 30)))


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by the continued fraction on the side where it converges fast."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    turned = x >= (a + 1) / (a + b + 2)
    p, q, z = np.where(turned, b, a), np.where(turned, a, b), np.clip(np.where(turned, 1 - x, x), 0, 1)
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    with np.errstate(all="ignore"):
        c = np.ones_like(z)
        d = 1 / guard(1 - (p + q) * z / (p + 1))
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / guard(1 + num * d)
                c = guard(1 + num / c)
                h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-13):
                break
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(z) + q * np.log1p(-z))
        inner = np.where(z <= 0, 0.0, front * h / p)
    out = np.where(turned, 1 - inner, inner)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


_erfc = np.frompyfunc(math.erfc, 1, 1)


def normal_tail(z: np.ndarray) -> np.ndarray:
    """P(Z > z) of the standard normal."""
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2)).astype(float)


def chi2_tail(x: np.ndarray) -> np.ndarray:
    """P(X > x) of chi-square with one degree of freedom."""
    return 2 * normal_tail(np.sqrt(np.maximum(np.asarray(x, float), 0)))


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def hypergeometric_sf(x: float, n: float, k: float, m: float) -> float:
    """P(X > x) for m draws from n items of which k are marked: one array over the shorter tail."""
    low, high = max(0, int(m + k - n)), int(min(k, m))
    x = int(math.floor(x))
    if x < low:
        return 1.0
    if x >= high:
        return 0.0
    upper = high - x <= x - low + 1
    i = np.arange(x + 1, high + 1, dtype=float) if upper else np.arange(low, x + 1, dtype=float)
    share = float(np.exp(log_choose(np.full_like(i, k), i) + log_choose(np.full_like(i, n - k), m - i) - log_choose(np.array([float(n)]), np.array([float(m)]))).sum())
    return min(1.0, share) if upper else max(0.0, 1.0 - share)


@lru_cache(maxsize=256)
def rank_sum_counts(n1: int, n2: int) -> np.ndarray:
    """How many orders of n1 and n2 different values have each Mann-Whitney U, as shares."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1.0
    for j in range(1, n1 + n2 + 1):  # the j-th smallest value goes to the first sample or not
        for i in range(min(j, n1), 0, -1):
            shift = j - i
            if shift <= n2:
                ways[i, shift:] += ways[i - 1, : ways.shape[1] - shift]
    return ways[n1] / ways[n1].sum()


def rank_sum_p(u: float, n1: int, n2: int, tie_term: float, side: str = "both") -> float:
    """p of the rank-sum test for U of the first sample: exact below 50 a side without ties, else normal.

    tie_term is the sum of t**3 - t over groups of equal values. The normal form corrects for ties and continuity.
    """
    if not n1 or not n2:
        return float("nan")
    if tie_term == 0 and n1 < 50 and n2 < 50:
        share = rank_sum_counts(n1, n2)
        above, below = share[int(u) :].sum(), share[: int(u) + 1].sum()
        return float(min(1.0, {"right": above, "left": below, "both": 2 * min(above, below)}[side]))
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - tie_term / (n * (n - 1)))
    if var <= 0:
        return 1.0
    d = u - n1 * n2 / 2
    z = {"right": d - 0.5, "left": -d - 0.5, "both": abs(d) - 0.5}[side] / math.sqrt(var)
    return float(min(1.0, (2 if side == "both" else 1) * normal_tail(np.array([z]))[0]))


@F.pandas_udf(DoubleType())
def hypergeometric_tail(x: pd.Series, n: pd.Series, k: pd.Series, m: pd.Series) -> pd.Series:
    """P(X > x) for m draws from n items of which k are marked."""
    return pd.Series([hypergeometric_sf(*row) for row in zip(x, n, k, m, strict=True)])


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t; null for a null t or no degrees of freedom."""
    v, n = t.to_numpy(float), df.to_numpy(float)
    p = beta_share(np.maximum(n, 1e-300) / 2, np.full(len(n), 0.5), np.where(np.isfinite(v), n / (n + v * v), 0.0))
    return pd.Series(np.where(np.isnan(v) | (n <= 0), np.nan, p)).replace({np.nan: None})


@F.pandas_udf(DoubleType())
def f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """P(F > f) with df1 and df2 degrees of freedom."""
    v, a, b = (s.to_numpy(float) for s in (f, df1, df2))
    return pd.Series(beta_share(b / 2, a / 2, np.where(np.isinf(v), 0.0, b / (b + a * v))))


@F.pandas_udf(DoubleType())
def beta_cdf(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_share(a.to_numpy(float), b.to_numpy(float), x.to_numpy(float)))


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series) -> pd.Series:
    """P(X > x) of chi-square with one degree of freedom."""
    return pd.Series(chi2_tail(x.to_numpy(float)))


@F.pandas_udf(DoubleType())
def rank_sum_test(u: pd.Series, n1: pd.Series, n2: pd.Series, tie_term: pd.Series) -> pd.Series:
    """Two-sided p of the rank-sum test."""
    return pd.Series([rank_sum_p(float(a), int(b), int(c), float(d)) for a, b, c, d in zip(u, n1, n2, tie_term, strict=True)])


def _logarithm(x: pd.Series, log: Callable[[float], float]) -> pd.Series:
    values, at = np.unique(x.to_numpy(float), return_inverse=True)
    return pd.Series(np.array([log(v) if v > 0 else np.nan for v in values.tolist()], float)[at])


@F.pandas_udf(DoubleType())
def log2(x: pd.Series) -> pd.Series:
    """Logarithm of the C library, which is exact for powers of two; Spark's is a quotient of two. NaN unless x > 0."""
    return _logarithm(x, math.log2)


@F.pandas_udf(DoubleType())
def log10(x: pd.Series) -> pd.Series:
    """As log2, to base 10."""
    return _logarithm(x, math.log10)
