"""Column expressions for entropy, correlation and rates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, 0.0 where the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def rounded(col: Column, digits: int = 6) -> Column:
    """Rounded value without a negative zero."""
    return F.round(col, digits) + F.lit(0.0)


def clog(count: Column) -> Column:
    """``c * log2(c)``, 0.0 for an empty cell."""
    c = count.cast("double")
    return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson r from sums; null when one side is constant."""
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    return F.when((vx > 0) & (vy > 0), (n * sxy - sx * sy) / (F.sqrt(vx) * F.sqrt(vy)))


def _beta_tail(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300

    def safe(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    c = np.ones_like(x)
    d = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        before = h
        for step in (even, odd):
            d = 1.0 / safe(1.0 + step * d)
            c = safe(1.0 + step / c)
            h = h * d * c
        if np.all(np.abs(h - before) <= 1e-14 * np.abs(h)):
            break
    return h


def _incomplete_beta(a: float, b: float, x: np.ndarray) -> np.ndarray:
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    with np.errstate(divide="ignore"):
        scale = np.exp(front + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1.0) / (a + b + 2.0)
    direct = scale * _beta_tail(a, b, np.where(low, x, 0.0)) / a
    mirrored = 1.0 - scale * _beta_tail(b, a, np.where(low, 0.0, 1.0 - x)) / b
    return np.where(low, direct, mirrored)


@F.pandas_udf(T.DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation over ``n`` rows (t test)."""
    out = np.full(len(r), np.nan)
    values = r.to_numpy(dtype=float, na_value=np.nan)
    for size in n.unique():
        dof = float(size) - 2.0
        rows = (n == size).to_numpy() & ~np.isnan(values)
        if dof > 0 and rows.any():
            x = np.clip(1.0 - values[rows] ** 2, 0.0, 1.0)
            out[rows] = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, _incomplete_beta(dof / 2, 0.5, np.clip(x, 1e-300, 1 - 1e-16))))
    return pd.Series(out).where(~np.isnan(out), None).astype("float64")
