"""Closed-form forecasts, horizons, bands and model choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.operators.frames import attach, over, ratio, rows_of
from stocktide.operators.series import indexed

BOUNDS = ["yhat", "yhat_lower", "yhat_upper"]


def horizon_rule(frame: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A quarter of the span in days, between 30 and 365."""
    out = frame.groupBy(*keys).agg(F.datediff(F.max("ds"), F.min("ds")).alias("span_days"))
    days = F.least(F.lit(365), F.greatest(F.lit(30), F.floor(F.col("span_days") * 0.25)))
    return out.withColumn("horizon", days.cast("int"))


def future_days(frame: DataFrame, keys: Sequence[str], horizon: int | Column) -> DataFrame:
    """Rows (keys, ds, step) for each day after the last one; step starts at 0.

    `horizon` is a number or a column of `frame` constant within a key.
    """
    h = F.lit(horizon) if isinstance(horizon, int) else F.max(horizon)
    ends = frame.groupBy(*keys).agg(F.max("ds").alias("_end"), h.cast("int").alias("horizon")).where(F.col("horizon") > 0)
    steps = ends.select(*keys, "_end", "horizon", F.explode(F.sequence(F.lit(0), F.col("horizon") - 1)).alias("step"))
    return steps.select(*keys, F.date_add("_end", F.col("step") + 1).alias("ds"), "step", "horizon")


def naive_drift(frame: DataFrame, keys: Sequence[str], horizon, name="Drift") -> DataFrame:
    """Last value plus a hundredth of evenly spaced points from 0 to the horizon."""
    last = frame.groupBy(*keys).agg(F.max_by("y", "ds").alias("_last"))
    days = attach(future_days(frame, keys, horizon), last, keys)
    h = F.col("horizon").cast("double")
    spaced = F.when(h > 1, F.col("step") * ratio(h, h - 1)).otherwise(0.0)
    y = F.col("_last") + 0.01 * spaced
    return days.select(*keys, F.lit(name).alias("model"), "ds", y.alias("yhat"), (y * 0.95).alias("yhat_lower"), (y * 1.05).alias("yhat_upper"))


def mean_trend(frame: DataFrame, keys: Sequence[str], horizon, name="Trend") -> DataFrame:
    """Mean of the history plus its slope per day ahead, with volatility bands."""
    y, i = F.col("y"), F.col("_i")
    fit = indexed(frame, keys, "ds").groupBy(*keys).agg(
        F.avg(y).alias("_mean"), F.coalesce(F.regr_slope(y, i), F.lit(0.0)).alias("_slope"), F.stddev(y).alias("_sd"))
    days = attach(future_days(frame, keys, horizon), fit, keys)
    days = days.withColumn("yhat", F.col("_mean") + F.col("_slope") * (F.col("step") + 1))
    return volatility_band(days, "_sd").select(*keys, F.lit(name).alias("model"), "ds", *BOUNDS)


def volatility_band(days: DataFrame, deviation: str) -> DataFrame:
    """Missing bands: 1.96 deviations, widening by half over the horizon."""
    width = 1.96 * F.col(deviation) * (1 + 0.5 * F.col("step") / F.col("horizon"))
    have = lambda c: F.col(c) if c in days.columns else F.lit(None).cast("double")
    return days.withColumns({
        "yhat_lower": F.coalesce(have("yhat_lower"), F.col("yhat") - width),
        "yhat_upper": F.coalesce(have("yhat_upper"), F.col("yhat") + width)})


# Member weights of the hybrid forecast.
HYBRID_WEIGHTS = {"Prophet": 0.4, "SARIMA": 0.3, "RandomForest": 0.3}


def hybrid(forecasts: DataFrame, keys: Sequence[str] = (), weights: dict[str, float] | None = None, name="Hybrid") -> DataFrame:
    """Weighted mean over the members present on a date; bands of ten percent."""
    rows = [(m, float(w)) for m, w in (weights or HYBRID_WEIGHTS).items()]
    table = rows_of(forecasts.sparkSession, rows, "model string, weight double")
    joined = forecasts.join(table, "model").where(F.col("yhat").isNotNull())
    y = ratio(F.sum(F.col("yhat") * F.col("weight")), F.sum("weight"))
    out = joined.groupBy(*keys, "ds").agg(y.alias("yhat"))
    return out.select(*keys, F.lit(name).alias("model"), "ds", "yhat", (F.col("yhat") * 0.9).alias("yhat_lower"), (F.col("yhat") * 1.1).alias("yhat_upper"))


def recommend(frame: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Score three model families from size, span, variability and trend.

    Ties go to the earlier name in the order Prophet, SARIMA, XGBoost.
    """
    at = indexed(frame, keys, "ds")
    facts = at.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("data_points"), F.datediff(F.max("ds"), F.min("ds")).alias("time_span_days"),
        F.when(F.avg("y") > 0, ratio(F.stddev("y"), F.avg("y"))).otherwise(0.0).alias("variability_cv"),
        F.abs(F.sqrt(F.regr_r2(F.col("y"), F.col("_i")))).alias("trend_strength"))
    n, span, cv, trend = (F.col(c) for c in ("data_points", "time_span_days", "variability_cv", "trend_strength"))
    pts = lambda cond, k: F.when(cond, F.lit(k)).otherwise(0)
    # Points per condition.
    prophet = pts(n >= 100, 30) + pts(trend > 0.5, 25) + pts(span > 365, 20) + pts(cv < 0.5, 15) + 10
    sarima = pts((n >= 50) & (n <= 500), 30) + pts((cv > 0.3) & (cv < 0.7), 25) + pts(span >= 180, 20) + 5
    xgboost = pts(n >= 50, 30) + pts(cv > 0.5, 25) + pts(trend < 0.3, 20) + 5
    out = facts.withColumns({"Prophet": prophet, "SARIMA": sarima, "XGBoost": xgboost})
    best = F.greatest("Prophet", "SARIMA", "XGBoost")
    pick = F.when(F.col("Prophet") == best, "Prophet").when(F.col("SARIMA") == best, "SARIMA").otherwise("XGBoost")
    return out.withColumn("recommended", pick).withColumn("confidence", F.least(F.lit(100), best))


def demand_outlook(outflows: DataFrame, dim: str = "Category", days: int = 30) -> DataFrame:
    """Mean and slope of daily demand per label, and the level `days` ahead."""
    daily = outflows.groupBy(dim, "Date").agg(F.sum("Quantity").alias("q"))
    at = indexed(daily, [dim], "Date")
    out = at.groupBy(dim).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("q").alias("_mean"), F.regr_slope(F.col("q"), F.col("_i")).alias("_slope"))
    ahead = F.greatest(F.lit(0.0), F.bround(F.col("_mean") + F.col("_slope") * days, 2))
    return out.where(F.col("_n") > 1).select(
        dim, F.bround("_mean", 2).alias("avg_daily_demand"), F.bround("_slope", 3).alias("trend_slope"), ahead.alias("forecast"))
