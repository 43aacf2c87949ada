"""Seasonal ARIMA by conditional least squares, one series per task.

The residual recursion is linear in the series and its own past, so a small
Levenberg-Marquardt loop over at most a handful of coefficients fits it. Groups
are single daily series, bounded by the calendar.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.operators.frames import attach

from .additive import normal_quantile

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER, SEASONAL = (1, 1, 1), (1, 1, 1, 12)
GRID = [(p, d, q) for p in range(3) for d in range(2) for q in range(3)]


def _poly(short: np.ndarray, seasonal: np.ndarray, s: int, sign: float) -> np.ndarray:
    """Coefficients of (1 + sign*short(B)) * (1 + sign*seasonal(B^s))."""
    a = np.concatenate([[1.0], sign * short])
    b = np.zeros(len(seasonal) * s + 1)
    b[0] = 1.0
    for i, v in enumerate(seasonal, 1):
        b[i * s] = sign * v
    return np.convolve(a, b)


def _split(theta, order, seasonal):
    p, q, P, Q = order[0], order[2], seasonal[0], seasonal[2]
    cut = np.cumsum([p, q, P])
    return np.split(theta, cut)


def residuals(w: np.ndarray, thetas: np.ndarray, order, seasonal) -> np.ndarray:
    """Residuals of the differenced series for several coefficient vectors at once."""
    s = max(seasonal[3], 1)
    ars, mas = [], []
    for th in thetas:
        ar, ma, sar, sma = _split(th, order, seasonal)
        ars.append(_poly(ar, sar, s, -1.0))
        mas.append(_poly(ma, sma, s, 1.0))
    ar_part = np.stack([np.convolve(w, a)[: len(w)] for a in ars])
    ma = np.stack(mas)[:, 1:]
    lag = ma.shape[1]
    if lag == 0:
        return ar_part
    e = np.zeros((len(thetas), len(w) + lag))
    back = ma[:, ::-1]
    for t in range(len(w)):
        e[:, t + lag] = np.clip(ar_part[:, t] - np.einsum("ij,ij->i", back, e[:, t:t + lag]), -1e8, 1e8)
    return e[:, lag:]


def fit(w: np.ndarray, order, seasonal, rounds: int = 12):
    """Least-squares coefficients, residuals and start index."""
    k = order[0] + order[2] + seasonal[0] + seasonal[2]
    burn = min(order[0] + seasonal[0] * seasonal[3], max(len(w) - 5, 0))
    theta = np.zeros(k)
    best = residuals(w, theta[None], order, seasonal)[0]
    if k == 0:
        return theta, best, burn
    cost, damp = float(np.sum(best[burn:] ** 2)), 1e-2
    for _ in range(rounds):
        h = 1e-4
        trial = theta[None] + np.vstack([np.zeros(k), np.eye(k) * h])
        r = residuals(w, trial, order, seasonal)[:, burn:]
        jac = ((r[1:] - r[0]) / h).T
        g, a = jac.T @ r[0], jac.T @ jac
        steps = []
        for lam in (damp, damp * 30, damp * 1000):
            steps.append(np.clip(theta - np.linalg.solve(a + lam * np.diag(np.diag(a) + 1e-9), g), -0.98, 0.98))
        costs = np.sum(residuals(w, np.stack(steps), order, seasonal)[:, burn:] ** 2, axis=1)
        i = int(np.argmin(costs))
        if not costs[i] < cost * (1 - 1e-7):
            break
        theta, cost, damp = steps[i], float(costs[i]), max(damp * (0.2 if i == 0 else 10.0), 1e-6)
    return theta, residuals(w, theta[None], order, seasonal)[0], burn


def difference(y: np.ndarray, order, seasonal) -> np.ndarray:
    for _ in range(order[1]):
        y = np.diff(y)
    for _ in range(seasonal[1]):
        y = y[seasonal[3]:] - y[:-seasonal[3]]
    return y


def predict(y: np.ndarray, order, seasonal, periods: int, level: float):
    """Fitted values (aligned to the end of y), forecasts, bounds and AIC."""
    s = max(seasonal[3], 1)
    w = difference(y, order, seasonal)
    mean = float(w.mean()) if order[1] + seasonal[1] == 0 else 0.0
    theta, e, burn = fit(w - mean, order, seasonal)
    ar, ma, sar, sma = _split(theta, order, seasonal)
    diff = np.array([1.0])
    for _ in range(order[1]):
        diff = np.convolve(diff, [1.0, -1.0])
    for _ in range(seasonal[1]):
        diff = np.convolve(diff, np.concatenate([[1.0], np.zeros(s - 1), [-1.0]]))
    full_ar = np.convolve(_poly(ar, sar, s, -1.0), diff)
    full_ma = _poly(ma, sma, s, 1.0)
    const = mean * float(np.sum(_poly(ar, sar, s, -1.0)))
    past, err = list(y), list(np.concatenate([np.zeros(len(y) - len(e)), e]))
    out = []
    for _ in range(periods):
        v = const - sum(full_ar[j] * past[-j] for j in range(1, min(len(full_ar), len(past) + 1)))
        v += sum(full_ma[j] * err[-j] for j in range(1, min(len(full_ma), len(err) + 1)))
        out.append(v)
        past.append(v)
        err.append(0.0)
    psi = np.zeros(periods)
    psi[0] = 1.0
    for i in range(1, periods):
        head = full_ma[i] if i < len(full_ma) else 0.0
        psi[i] = head - sum(full_ar[j] * psi[i - j] for j in range(1, min(len(full_ar), i + 1)))
    n = max(len(e) - burn, 1)
    var = max(float(np.sum(e[burn:] ** 2)) / n, 1e-12)
    half = normal_quantile(0.5 + level / 2) * np.sqrt(var * np.cumsum(psi**2))
    k = len(theta) + 1 + (1 if mean else 0)
    aic = n * (np.log(2 * np.pi * var) + 1) + 2 * k
    fitted = y[len(y) - len(e):] - e
    mid = np.array(out)
    return fitted, mid, mid - half, mid + half, float(aic)


# A seasonal part needs more days than SEASONS seasons and SPARE_DAYS; any order needs its own terms and LEAST_DAYS.
SEASONS, SPARE_DAYS, LEAST_DAYS = 4, 10, 5


def used_orders(frame: DataFrame, keys: Sequence[str], order=ORDER, seasonal=SEASONAL, orders: DataFrame | None = None) -> DataFrame:
    """The order that `forecast` fits for each key, with the reason where it is less than the one asked for.

    Columns keys, days, p, d, q, sp, sd, sq, season, reason: `too short for the season`, `too short for the order`
    (then neither is fitted) or missing. A key without a known level has zero days.
    """
    days = frame.groupBy(*keys).agg(F.count("y").alias("days"))
    wanted = list(zip(("p", "d", "q"), order))
    days = attach(days, orders.select(*keys, "p", "d", "q"), keys) if orders is not None else days.withColumns({c: F.lit(v) for c, v in wanted})
    short = F.col("days") < F.col("p") + F.col("d") + F.col("q") + LEAST_DAYS
    brief = (F.col("days") <= SEASONS * max(seasonal[3], 1) + SPARE_DAYS) & F.lit(any(seasonal))
    reason = F.when(short, "too short for the order").when(brief, "too short for the season")
    part = lambda c, off: F.when(off, 0).otherwise(c)
    return days.select(
        *keys, "days", *[part(F.col(c), short).cast("int").alias(c) for c in ("p", "d", "q")],
        *[part(F.lit(v), brief).cast("int").alias(c) for c, v in zip(("sp", "sd", "sq", "season"), seasonal)], reason.alias("reason"))


def _task(key_names, periods, level, name, seasonal, mode):
    """The per-series function: `mode` is forecast, score or history."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        keep = pdf["y"].notna()
        y, ds = pdf.loc[keep, "y"].to_numpy(dtype=float), pd.to_datetime(pdf.loc[keep, "ds"])
        keys = {k: pdf[k].iloc[0] for k in key_names}
        order = tuple(int(pdf[c].iloc[0]) for c in ("p", "d", "q"))
        season = seasonal if len(y) > SEASONS * max(seasonal[3], 1) + SPARE_DAYS else (0, 0, 0, 0)
        if len(y) < sum(order) + LEAST_DAYS:
            order = (0, 0, 0)
        size = float(np.std(y)) or 1.0
        fitted, mid, low, high, aic = predict(y / size, order, season, periods, level)
        if mode == "score":
            # Scores compare orders on the scale of the data.
            n = len(fitted)
            return pd.DataFrame([{**keys, "p": order[0], "d": order[1], "q": order[2], "aic": aic + 2 * n * np.log(size)}])
        future = pd.date_range(ds.iloc[-1] + pd.Timedelta(days=1), periods=periods)
        parts = [pd.DataFrame({"ds": future, "yhat": mid, "yhat_lower": low, "yhat_upper": high, "is_history": False})]
        if mode == "history":
            parts.insert(0, pd.DataFrame({"ds": ds.iloc[-len(fitted):], "yhat": fitted, "yhat_lower": fitted, "yhat_upper": fitted, "is_history": True}))
        out = pd.concat(parts, ignore_index=True)
        out["ds"] = out["ds"].dt.date
        for c in ("yhat", "yhat_lower", "yhat_upper"):
            out[c] = out[c] * size
        for k, v in keys.items():
            out[k] = v
        out["model"] = name
        return out[[*key_names, "model", "ds", "yhat", "yhat_lower", "yhat_upper", "is_history"]]

    return one


def _head(frame, keys):
    return "".join(f"`{k}` {dict(frame.dtypes)[k]}, " for k in keys)


def forecast(
    frame: DataFrame, keys: Sequence[str], periods: int, level: float = 0.95, order=ORDER, seasonal=SEASONAL,
    orders: DataFrame | None = None, history: bool = False, name: str = "SARIMA",
) -> DataFrame:
    """Seasonal ARIMA per key; `orders` may give p, d, q per key instead."""
    keys = list(keys)
    rows = frame.select(*keys, "ds", "y")
    if orders is not None:
        rows = rows.join(orders.select(*keys, "p", "d", "q"), keys) if keys else rows.select(
            "*", *[orders.select(c).scalar().alias(c) for c in ("p", "d", "q")])
    else:
        rows = rows.select("*", *[F.lit(v).alias(c) for c, v in zip(("p", "d", "q"), order)])
    schema = _head(frame, keys) + "model string, ds date, yhat double, yhat_lower double, yhat_upper double, is_history boolean"
    task = _task(keys, periods, level, name, tuple(seasonal), "history" if history else "forecast")
    group = rows.groupBy(*keys) if keys else rows.withColumn("_one", F.lit(1)).groupBy("_one")
    return group.applyInPandas(task, schema)


def search_orders(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AIC of every order per key; each (key, order) pair is its own task."""
    keys = list(keys)
    orders = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("p", "d", "q"), o)]) for o in GRID]))
    rows = frame.select(*keys, "ds", "y", orders.alias("_o")).select(*keys, "ds", "y", "_o.p", "_o.d", "_o.q")
    schema = _head(frame, keys) + "p int, d int, q int, aic double"
    task = _task(keys, 1, 0.95, "", (0, 0, 0, 0), "score")
    return rows.groupBy(*keys, "p", "d", "q").applyInPandas(task, schema)


def best_orders(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    best = scores.groupBy(*keys).agg(F.min_by(F.struct("p", "d", "q", "aic"), F.struct("aic", "p", "d", "q")).alias("_b"))
    return best.select(*keys, "_b.*")
