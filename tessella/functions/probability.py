"""Moments and intervals of uncertain dates: uniform, normal, triangular and beta on a range."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

HALVINGS = 60
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, for x below its turning point; by Lentz's method until all are settled."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h, m, moving = d.copy(), 1, True
    while moving:
        moving = False
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
            moving = bool((np.abs(c * d - 1) > 1e-14).any())
        m += 1
    return h


def beta_below(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function for 0 < x < 1: the share of beta(a, b) below x."""
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x))
    swap = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    part = front * _fraction(y, p, q) / p
    return np.where(swap, 1 - part, part)


@F.pandas_udf(DoubleType())
def beta_quantile(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """The x with a share p of beta(a, b) below it, by halving; null for nulls, shapes that aren't positive and finite, and shares outside 0..1."""
    q, s, t = (v.to_numpy(dtype=float, na_value=np.nan) for v in (p, a, b))
    ok = (q >= 0) & (q <= 1) & (s > 0) & (t > 0) & np.isfinite(s) & np.isfinite(t)
    out = np.full(len(q), np.nan)
    q, s, t = q[ok], s[ok], t[ok]
    low, high = np.zeros_like(q), np.ones_like(q)
    for _ in range(HALVINGS if len(q) else 0):
        half = (low + high) / 2
        under = beta_below(half, s, t) < q
        low, high = np.where(under, half, low), np.where(under, high, half)
    out[ok] = np.where(q == 0, 0.0, np.where(q == 1, 1.0, (low + high) / 2))
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def mean(kind: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """uniform(a, b); normal(mean a, sd b); triangular(a, b, mode c); beta on a..b with shapes c and d."""
    return F.when(kind == "uniform", (a + b) / 2).when(kind == "normal", a).when(kind == "triangular", (a + b + c) / 3).when(kind == "beta", a + (b - a) * c / (c + d))


def std(kind: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    tri = (a * a + b * b + c * c - a * b - a * c - b * c) / 18
    return (
        F.when(kind == "uniform", (b - a) / F.sqrt(F.lit(12.0)))
        .when(kind == "normal", b)
        .when(kind == "triangular", F.sqrt(tri))
        .when(kind == "beta", (b - a) * F.sqrt(c * d / ((c + d) * (c + d) * (c + d + 1))))
    )


def interval(kind: Column, a: Column, b: Column, c: Column, d: Column, level: float = 0.95) -> Column:
    """struct(low, high): the quantiles that leave equal tails, exact for all four kinds (beta by a kernel). ``level`` lies between 0 and 1."""
    tail = (1 - level) / 2
    z = NormalDist().inv_cdf(1 - tail)
    cut = (c - a) / (b - a)
    is_beta = kind == "beta"

    def quantile(p: float) -> Column:
        triangular = F.when(F.lit(p) <= cut, a + F.sqrt(p * (b - a) * (c - a))).otherwise(b - F.sqrt((1 - p) * (b - a) * (b - c)))
        beta = a + (b - a) * beta_quantile(F.lit(p), F.when(is_beta, c), F.when(is_beta, d))
        sign = z if p > 0.5 else -z
        return F.when(kind == "uniform", a + p * (b - a)).when(kind == "normal", a + sign * b).when(kind == "triangular", triangular).when(is_beta, beta)

    return F.struct(quantile(tail).alias("low"), quantile(1 - tail).alias("high"))


def combined(m: str, s: str, w: str) -> tuple[Column, Column]:
    """Aggregates for the mean and standard deviation of a weighted mixture (law of total variance)."""
    total = F.sum(w)
    centre = F.sum(F.col(m) * F.col(w)) / total
    second = F.sum(F.col(w) * (F.col(s) * F.col(s) + F.col(m) * F.col(m))) / total
    return centre, F.sqrt(F.greatest(second - centre * centre, F.lit(0.0)))


def path_confidence(confidences: Column, decay: float = 0.9) -> Column:
    """Product of the confidences along a path, times ``decay`` for each step after the first."""
    product = F.aggregate(confidences, F.lit(1.0), lambda a, x: a * x)
    return product * F.pow(F.lit(decay), F.greatest(F.size(confidences) - 1, F.lit(0)))


def aggregate_confidence(values: Column) -> Column:
    """0.7 of the mean and 0.3 of the least value; 0 for no values."""
    mean_ = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return F.when(F.size(values) > 0, 0.7 * mean_ + 0.3 * F.array_min(values)).otherwise(0.0)
