"""Distribution tails for test statistics (no SciPy).

These run on *summary* rows only (one row per test, arm or segment), through
Arrow-batched pandas UDFs.  Student's t: its density, relative to the density at
the statistic, is integrated over the tail with the double-exponential rule, so no
difference of large numbers occurs at any df.  Chi-square: whole degrees of
freedom have finite sums.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gamma_half_step(z: float) -> float:
    """Gamma(z + 1/2) / Gamma(z): its asymptotic series, after stepping z up to
    where the series is exact to double precision."""
    step = 1.0
    while z < 60:
        step *= z / (z + 0.5)
        z += 1.0
    w = 1.0 / z
    return step * math.sqrt(z) * (1 + w * (-1 / 8 + w * (1 / 128 + w * (5 / 1024 + w * (-21 / 32768 + w * (-399 / 262144))))))


def t_two_sided_p(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    t = abs(t)
    if t == 0 or math.isinf(t):
        return float(t == 0)
    half, base, scale, width = (df + 1) / 2, df + t * t, 1 / max(t, 1.0), 1 / 64
    total = []
    for i in range(-320, 321):  # tail point t + s, s = scale * exp(pi/2 sinh u)
        u = i * width
        s = scale * math.exp(math.pi / 2 * math.sinh(u))
        weight = math.pi / 2 * math.cosh(u) * s
        total.append(weight * math.exp(-half * math.log1p(s * (2 * t + s) / base)))
    density = gamma_half_step(df / 2) / math.sqrt(math.pi * df) * math.exp(-half * math.log1p(t * t / df))
    return min(1.0, 2 * density * width * math.fsum(total))


def chi2_sf(x: float, k: float) -> float:
    """P(X >= x) for a chi-square law with ``k`` (whole) degrees of freedom."""
    if x is None or k is None or math.isnan(x) or math.isnan(k) or k <= 0:
        return float("nan")
    if k != int(k):
        raise ValueError("chi-square tail: whole degrees of freedom only")
    if x <= 0:
        return 1.0
    y, odd = x / 2, int(k) % 2
    term = lambda e: math.exp(e * math.log(y) - y - math.lgamma(e + 1))
    sums = math.fsum(term(i + (0.5 if odd else 0.0)) for i in range(int(k) // 2))
    return min(1.0, sums + (math.erfc(math.sqrt(y)) if odd else 0.0))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def power_constant(alpha: float = 0.05, power: float = 0.80) -> float:
    """2 (z_{1-alpha/2} + z_power)^2: required n per arm = constant / d^2."""
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    return 2.0 * z * z


@F.pandas_udf(T.DoubleType())
def _t_p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _chi2_p_udf(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, b) for a, b in zip(x, k)], dtype="float64")


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic (summary rows only)."""
    return _t_p_udf(t.cast("double"), df.cast("double"))


def chi2_p_value(x: Column, k: Column) -> Column:
    return _chi2_p_udf(x.cast("double"), k.cast("double"))
