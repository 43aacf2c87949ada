"""Additive model: piecewise-linear trend, Fourier seasons and regressors.

Follows the structure of Taylor and Letham (2018) with Gaussian priors, so the
most probable coefficients are a ridge solution. One series is fitted per task;
its rows are days, so a group is bounded by the calendar.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.operators.series import carry_into_horizon

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values: (period in days, Fourier order) per season and prior scales.
SEASONS = {"yearly": (365.25, 10), "weekly": (7.0, 3), "monthly": (30.5, 5), "quarterly": (91.25, 8)}
CHANGEPOINTS, CHANGE_RANGE, CHANGE_SCALE, SEASON_SCALE = 25, 0.8, 0.05, 10.0


def normal_quantile(p: float) -> float:
    """Inverse normal distribution by bisection on erfc."""
    lo, hi = -10.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def design(t: np.ndarray, days: np.ndarray, knots: np.ndarray, extra: np.ndarray, seasons):
    cols = [np.ones_like(t), t, *[np.maximum(t - k, 0.0) for k in knots]]
    for period, order in seasons:
        for n in range(1, order + 1):
            angle = 2 * np.pi * n * days / period
            cols += [np.sin(angle), np.cos(angle)]
    return np.column_stack([*cols, extra]) if extra.size else np.column_stack(cols)


def fit_predict(days, y, future, extra, extra_future, seasons, level, change_scale=CHANGE_SCALE):
    """Fitted and future yhat with bounds; `days` are day numbers."""
    start, span = days.min(), max(float(days.max() - days.min()), 1.0)
    size = float(np.max(np.abs(y))) or 1.0
    z = y / size
    t, tf = (days - start) / span, (future - start) / span
    knots = np.linspace(0, CHANGE_RANGE, min(CHANGEPOINTS, max(len(y) // 3, 0)) + 1)[1:]
    if extra.size:
        mean, sd = extra.mean(axis=0), extra.std(axis=0)
        sd = np.where(sd > 0, sd, 1.0)
        extra, extra_future = (extra - mean) / sd, (extra_future - mean) / sd
    x, xf = design(t, days, knots, extra, seasons), design(tf, future, knots, extra_future, seasons)
    prior = np.full(x.shape[1], SEASON_SCALE)
    prior[0:2] = 5.0
    prior[2:2 + len(knots)] = change_scale
    noise = float(np.std(np.diff(z))) / math.sqrt(2) + 1e-6 if len(z) > 2 else 0.1
    for _ in range(4):
        lhs = x.T @ x / noise**2 + np.diag(1.0 / prior**2)
        beta = np.linalg.solve(lhs, x.T @ z / noise**2)
        noise = max(float(np.sqrt(np.mean((z - x @ beta) ** 2))), 1e-6)
    q = normal_quantile(0.5 + level / 2)
    ahead = np.maximum(tf - t.max(), 0.0)
    # Future slope changes arrive at the historical rate with their mean size.
    rate = len(knots) / CHANGE_RANGE if len(knots) else 0.0
    typical = float(np.mean(np.abs(beta[2:2 + len(knots)]))) if len(knots) else 0.0
    drift = 2 * typical**2 * rate * ahead**3 / 3
    mid = xf @ beta
    half = q * np.sqrt(noise**2 + drift)
    return mid * size, (mid - half) * size, (mid + half) * size


def forecast(
    frame: DataFrame, keys: Sequence[str], periods: int, level: float = 0.95, regressors: Sequence[str] = (),
    custom_seasons: bool = True, change_scale: float = CHANGE_SCALE, name: str = "Prophet",
) -> DataFrame:
    """In-sample fit and `periods` future days per key, marked by is_history.

    Regressors hold their last known value over the horizon.
    """
    cols = ["y", *regressors]
    rows = carry_into_horizon(frame, keys, "ds", list(regressors), periods) if regressors else carry_into_horizon(frame, keys, "ds", [], periods)
    rows = rows.join(frame.select(*keys, "ds", "y"), [*keys, "ds"], "left").select(*keys, "ds", "is_future", *cols)
    seasons = [SEASONS[s] for s in (SEASONS if custom_seasons else ("yearly", "weekly"))]
    key_names, extra_names = list(keys), list(regressors)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        days = (pd.to_datetime(pdf["ds"]) - pd.Timestamp("1970-01-01")).dt.days.to_numpy(dtype=float)
        known = ~pdf["is_future"].to_numpy(dtype=bool)
        extra = pdf[extra_names].to_numpy(dtype=float)
        y = pdf["y"].to_numpy(dtype=float)[known]
        use = ~np.isnan(y)
        mid, low, high = fit_predict(days[known][use], y[use], days, extra[known][use], extra, seasons, level, change_scale)
        out = pdf[key_names].copy()
        out["model"], out["ds"] = name, pdf["ds"]
        out["yhat"], out["yhat_lower"], out["yhat_upper"], out["is_history"] = mid, low, high, known
        return out

    head = "".join(f"`{k}` {dict(frame.dtypes)[k]}, " for k in key_names)
    schema = f"{head}model string, ds date, yhat double, yhat_lower double, yhat_upper double, is_history boolean"
    grouped = rows.groupBy(*key_names) if key_names else rows.withColumn("_one", F.lit(1)).groupBy("_one")
    return grouped.applyInPandas(one, schema)
