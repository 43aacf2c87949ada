"""Tail probabilities of the test statistics.

Each is a vectorised function over result rows (one row per test); all counting
and ranking has happened in Spark before.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


# Tasks receive these helpers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    if not (df > 0) or math.isnan(t):
        return float("nan")
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def chi2_tail(x: float, df: float) -> float:
    """Upper regularised gamma: series below df / 2 + 1, continued fraction above."""
    if not (df > 0) or math.isnan(x):
        return float("nan")
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = z + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def normal_two_sided(z: float) -> float:
    return min(1.0, math.erfc(abs(z) / math.sqrt(2.0)))


def kolmogorov_tail(d: float, n1: float, n2: float) -> float:
    """Limiting distribution of the two-sample statistic."""
    if not (n1 > 0 and n2 > 0):
        return float("nan")
    lam = d * math.sqrt(n1 * n2 / (n1 + n2))
    if lam < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2.0 * (k * lam) ** 2) for k in range(1, 101))
    return min(1.0, max(0.0, 2.0 * total))


def _vectorised(fn):
    """A column function over `fn`; the UDF is made on the driver when used."""

    def apply(*cols):
        @pandas_udf("double")
        def tail(*series: pd.Series) -> pd.Series:
            rows = zip(*(s.astype("float64") for s in series))
            return pd.Series([fn(*r) for r in rows], dtype="float64")

        return tail(*[F.col(c) if isinstance(c, str) else c for c in cols])

    return apply


t_p = _vectorised(t_two_sided)
chi2_p = _vectorised(chi2_tail)
normal_p = _vectorised(normal_two_sided)
ks_p = _vectorised(kolmogorov_tail)


def slope_p(r2, n):
    """p-value of a regression slope from r2 and the number of points."""
    t = F.sqrt(r2 * (n - 2) / F.when(r2 < 1, 1 - r2))
    return F.when(r2 >= 1, F.lit(0.0)).otherwise(t_p(t, (n - 2).cast("double")))
