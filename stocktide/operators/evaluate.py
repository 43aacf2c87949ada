"""Forecast evaluation, confidence and combination.

Forecasts are one long table: keys, model, ds, yhat, yhat_lower, yhat_upper.
Actuals are keys, ds, y.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import attach, over, ratio
from .series import positional_split


def _zero_safe(y: Column) -> Column:
    return F.when(y != 0, y).otherwise(F.lit(1.0))


def compare(actual: DataFrame, forecasts: DataFrame, keys: Sequence[str] = (), after: Column | None = None) -> DataFrame:
    """Actual against predicted on common dates, with errors."""
    if after is not None:
        forecasts = forecasts.where(F.col("ds") > after)
    rows = actual.select(*keys, "ds", "y").join(forecasts, [*keys, "ds"])
    err = F.col("y") - F.col("yhat")
    return rows.select(
        *keys, "model", "ds", F.col("y").alias("Actual"), F.col("yhat").alias("Predicted"), "yhat_lower", "yhat_upper",
        err.alias("Error"), F.abs(err).alias("Absolute_Error"), (err / _zero_safe(F.col("y")) * 100).alias("Percentage_Error"))


def accuracy(actual: DataFrame, forecasts: DataFrame, keys: Sequence[str] = (), empty: float = 0.0) -> DataFrame:
    """RMSE, MAE, MAPE and the number of compared days per key and model.

    Without a common date the scores are `empty`; `compared_days` is 0 there, so they are not taken for a perfect fit.
    """
    group = [*keys, "model"]
    rows = compare(actual, forecasts, keys)
    scored = rows.groupBy(*group).agg(
        F.sqrt(F.avg(F.col("Error") * F.col("Error"))).alias("rmse"), F.avg("Absolute_Error").alias("mae"),
        F.avg(F.abs("Percentage_Error")).alias("mape"), F.count("Error").alias("compared_days"))
    everyone = forecasts.select(*group).distinct()
    out = everyone.join(scored, group, "left").na.fill(0, ["compared_days"])
    return out.na.fill(float(empty), ["rmse", "mae", "mape"])


def extended_accuracy(actual: DataFrame, forecasts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Error, percentage, direction, fit and interval metrics per key and model.

    Percentages leave out zero actuals.
    """
    group = [*keys, "model"]
    w = over(group, "ds")
    rows = compare(actual, forecasts, keys).where(F.col("Actual").isNotNull() & F.col("Predicted").isNotNull())
    a, p = F.col("Actual"), F.col("Predicted")
    pct = F.when(a != 0, F.abs(F.col("Error") / _zero_safe(a)) * 100)
    same = (a - F.lag(a).over(w) > 0) == (p - F.lag(p).over(w) > 0)
    rows = rows.withColumns({"_pct": pct, "_same": same.cast("double")})
    inside = ((a >= F.col("yhat_lower")) & (a <= F.col("yhat_upper"))).cast("double")
    sse = F.sum(F.col("Error") * F.col("Error"))
    sst = F.var_pop(a) * F.count(a)
    return rows.groupBy(*group).agg(
        F.avg("Absolute_Error").alias("mae"), F.avg(F.col("Error") * F.col("Error")).alias("mse"),
        F.sqrt(F.avg(F.col("Error") * F.col("Error"))).alias("rmse"), F.coalesce(F.avg("_pct"), F.lit(0.0)).alias("mape"),
        F.coalesce(F.percentile("_pct", 0.5), F.lit(0.0)).alias("median_ape"), (F.avg("_same") * 100).alias("direction_accuracy"),
        F.when(sst != 0, 1 - ratio(sse, sst)).otherwise(0.0).alias("r_squared"),
        (F.avg(inside) * 100).alias("coverage"), F.avg(F.col("yhat_upper") - F.col("yhat_lower")).alias("avg_width"))


def _band(value: Column, steps: Sequence[tuple[float, str]], last: str, above: bool) -> Column:
    out = F.lit(last)
    for bound, name in reversed(list(steps)):
        out = F.when(value > bound if above else value < bound, name).otherwise(out)
    return out


# Rating bands.
MAPE_BANDS = [(10, "Excellent"), (20, "Good"), (30, "Acceptable")]
FIT_BANDS = [(0.9, "Excellent"), (0.7, "Good"), (0.5, "Moderate")]
DIRECTION_BANDS = [(80, "Excellent"), (60, "Good"), (50, "Acceptable")]


def ratings(metrics: DataFrame) -> DataFrame:
    val = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return metrics.withColumns({
        "mape_rating": _band(val("mape"), MAPE_BANDS, "Poor", above=False),
        "fit_quality": _band(val("r_squared"), FIT_BANDS, "Poor", above=True),
        "trend_prediction": _band(val("direction_accuracy"), DIRECTION_BANDS, "Poor", above=True)})


def error_histogram(rows: DataFrame, group: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width error bins per group."""
    ends = rows.groupBy(*group).agg(F.min("Error").alias("_lo"), F.max("Error").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.floor(ratio(F.col("Error") - F.col("_lo"), width, 0.0)), F.lit(bins - 1))
    return attach(rows, ends, group).groupBy(*group, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def stability(actual: DataFrame, forecasts: DataFrame, keys: Sequence[str] = (), parts: int = 3) -> DataFrame:
    """Accuracy in consecutive parts of the actuals and the variance of the RMSE."""
    split = positional_split(actual, keys, "ds", parts)
    group = [*keys, "model"]
    rows = split.select(*keys, "ds", "y", "part").join(forecasts, [*keys, "ds"])
    err = F.col("y") - F.col("yhat")
    per = rows.groupBy(*group, "part").agg(
        F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
        F.avg(F.abs(err / _zero_safe(F.col("y"))) * 100).alias("mape"))
    return per.withColumn("rmse_variance", F.var_pop("rmse").over(over(group)))


def stability_report(train: DataFrame, tune: DataFrame, forecasts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Days covered, scale band and number of models per key."""
    def side(df, tag):
        return df.groupBy(*keys).agg(F.datediff(F.max("ds"), F.min("ds")).alias(f"_{tag}_days"), F.avg("y").alias(f"_{tag}_mean"))

    out = attach(side(train, "a"), side(tune, "b"), keys)
    out = attach(out, forecasts.groupBy(*keys).agg(F.countDistinct("model").alias("_models")), keys)
    r = F.when(F.col("_a_mean") != 0, ratio("_b_mean", "_a_mean")).otherwise(1.0)
    n = F.coalesce(F.col("_models"), F.lit(0))
    return out.select(
        *keys, (F.col("_a_days") + F.col("_b_days")).alias("coverage_days"), r.alias("scale_ratio"),
        F.when(r.between(0.8, 1.2), "Good").when(r.between(0.5, 2.0), "Moderate").otherwise("Poor").alias("scale_adaptation"),
        n.alias("models"), F.when(n >= 2, "multiple").when(n == 1, "single").otherwise("none").alias("consistency"))


def confidence(forecasts: DataFrame, metrics: DataFrame, train: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Score 0..100 per forecast row from width, distance, accuracy, stability.

    Days ahead count from the last training date.
    """
    base = train.groupBy(*keys).agg(F.avg("y").alias("_mean"), F.stddev("y").alias("_sd"), F.max("ds").alias("_end"))
    mae = F.when(F.col("compared_days") > 0, F.col("mae")).alias("mae") if "compared_days" in metrics.columns else "mae"
    rows = attach(forecasts, base, keys).join(metrics.select(*keys, "model", mae), [*keys, "model"], "left")
    # `greatest` skips nulls, so a missing share must be kept missing here.
    floor0 = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), c))
    width = ratio(F.col("yhat_upper") - F.col("yhat_lower"), F.abs("yhat"))
    interval = F.coalesce(floor0(1 - width / 2), F.lit(0.5))
    days = F.datediff("ds", "_end")
    distance = floor0(1 - days / F.lit(180.0))
    performance = F.when(F.col("_mean") > 0, F.coalesce(floor0(1 - ratio("mae", "_mean")), F.lit(0.5))).otherwise(0.5)
    cv = F.when(F.col("_mean") > 0, ratio("_sd", "_mean")).otherwise(1.0)
    steady = floor0(1 - F.least(cv, F.lit(1.0)))
    score = (0.3 * interval + 0.25 * distance + 0.25 * performance + 0.2 * steady) * 100
    factors = F.struct((interval * 100).alias("interval"), (distance * 100).alias("distance"),
                       (performance * 100).alias("performance"), (steady * 100).alias("stability"))
    out = rows.select(*keys, "model", "ds", score.alias("confidence"), factors.alias("factors"))
    band = F.when(F.col("confidence") >= 80, "High").when(F.col("confidence") >= 60, "Medium").otherwise("Low")
    return out.withColumn("category", band)


def confidence_summary(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    days = lambda c: F.count_if(F.col("category") == c)
    return scores.groupBy(*keys, "model").agg(
        F.avg("confidence").alias("average_confidence"), days("High").alias("high_days"),
        days("Medium").alias("medium_days"), days("Low").alias("low_days"))


def ensemble_weights(metrics: DataFrame, keys: Sequence[str] = (), method: str = "weighted") -> DataFrame:
    """Weights per key and model that sum to one; keys with one model drop out.

    weighted: exp(-MAPE / 10), unusable MAPE counts as weight 1 before scaling;
    average: equal; best: all weight on the strongest model.
    """
    m = F.col("mape")
    usable = m.isNotNull() & ~F.isnan(m) & (m > 0) & (m < F.lit(float("inf")))
    raw = F.when(usable, F.exp(-m / 10)).otherwise(1.0)
    w = over(keys)
    out = metrics.withColumn("_raw", raw).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= 2)
    if method == "average":
        share = 1 / F.col("_n")
    elif method == "best":
        share = (F.row_number().over(over(keys, F.desc("_raw"), "model")) == 1).cast("double")
    else:
        total = F.sum("_raw").over(w)
        share = F.when(total > 0, ratio(F.col("_raw"), total)).otherwise(1 / F.col("_n"))
    return out.withColumn("weight", share).drop("_raw", "_n")


def ensemble(forecasts: DataFrame, weights: DataFrame, keys: Sequence[str] = (), name="Ensemble", sets: Sequence[str] = ()) -> DataFrame:
    """Weighted sum of the members' forecasts on each date.

    A date some members lack is averaged over the members that have it. `sets` are columns of `weights` that
    tell several sets of weights apart; each gives an ensemble from one pass over the forecasts.
    """
    rows = forecasts.join(weights.select(*keys, *sets, "model", "weight"), [*keys, "model"])
    total = F.sum("weight")
    mean = lambda c: ratio(F.sum(F.col(c) * F.col("weight")), total).alias(c)
    out = rows.groupBy(*sets, *keys, "ds").agg(mean("yhat"), mean("yhat_lower"), mean("yhat_upper"))
    return out.withColumn("model", F.lit(name)).where(F.col("yhat").isNotNull())


def ensemble_metrics(weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted mean of the members' metrics."""
    w = lambda c: F.sum(F.col(c) * F.col("weight")).alias(c)
    return weights.groupBy(*keys).agg(w("rmse"), w("mae"), w("mape"))


def comparison_table(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Models side by side, best MAPE first."""
    return metrics.withColumn("rank", F.row_number().over(over(keys, "mape", "model")))


def high_uncertainty(metrics: DataFrame, keys: Sequence[str] = (), limit: float = 30.0) -> DataFrame:
    return metrics.groupBy(*keys).agg(F.bool_or(F.col("mape") > limit).alias("uncertain"))
