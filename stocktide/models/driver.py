"""Forecast runs: prepare, fit the chosen models, score and combine.

Frames are immutable, metrics are in the units of the data, and every model is
fitted for all series at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.operators import clean as C
from stocktide.operators import evaluate as E
from stocktide.operators import series as S
from stocktide.operators.drift import scale_shift
from stocktide.operators.frames import attach, over, present
from stocktide.session import materialize

from . import additive, arima, simple, trees

METHODS = {"Prophet": ["Prophet"], "SARIMA": ["SARIMA"], "XGBoost": ["XGBoost"], "Both": ["Prophet", "SARIMA"],
           "All": ["Prophet", "SARIMA", "XGBoost"], "RandomForest": ["RandomForest"], "Hybrid": ["Hybrid"]}
COLUMNS = ["model", "ds", "yhat", "yhat_lower", "yhat_upper", "is_history"]


def _stack(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def fit_models(frame: DataFrame, keys: Sequence[str], periods: int, level: float, names: Sequence[str]) -> DataFrame:
    """Forecast table of the named models on one training frame, with in-sample rows of each."""
    done = []
    for n in names:
        if n == "Prophet":
            done.append(additive.forecast(frame, keys, periods, level, present(frame, S.FEATURES)))
        elif n == "SARIMA":
            done.append(arima.forecast(frame, keys, periods, level, history=True))
        elif n == "XGBoost":
            done.append(trees.forecast_boosted(frame, keys, periods, history=True))
        elif n == "RandomForest":
            done.append(trees.forecast_forest(frame, keys, periods))
        elif n == "Hybrid":
            members = materialize(fit_models(frame, keys, periods, level, list(simple.HYBRID_WEIGHTS)), "members")
            done.append(simple.hybrid(members, [*keys, "is_history"]))
        else:
            raise ValueError(f"unknown model {n}")
    return _stack([d.select(*keys, *COLUMNS) for d in done])


def run(train: DataFrame, tune: DataFrame, keys: Sequence[str] = (), method: str = "Prophet", periods: int = 90, level: float = 0.95,
        handle_outliers: bool = True, scale: bool = True) -> dict[str, DataFrame]:
    """Forecasts, accuracy on tune, stability report and confidence scores.

    `train` and `tune` are model frames (keys, ds, y, optional flow features).
    The forecasts are written once and read by every later step.
    """
    fit_on = train
    if handle_outliers:
        fit_on = C.clip_to_fence(fit_on, "y", keys)
    params = C.scale_parameters(fit_on, "y", keys)
    fitted = C.standardize(fit_on, params, ["y"], keys) if scale else fit_on
    table = fit_models(fitted, keys, periods, level, METHODS[method])
    if scale:
        table = C.standardize(table, params, ["yhat", "yhat_lower", "yhat_upper"], keys, inverse=True)
    table = materialize(table, "forecasts")
    metrics = E.accuracy(tune, table, keys)
    future = table.where(~F.col("is_history"))
    return {
        "forecasts": table, "metrics": metrics,
        "stability": E.stability_report(train, tune, future, keys),
        "confidence": E.confidence(future, metrics, train, keys)}


def request(train: DataFrame, tune: DataFrame | None, keys=(), model: str = "prophet", periods: int = 90, level: float = 0.95, use_tuning_data: bool = True):
    """Forecast request with checked arguments: returns run() for one model."""
    known = {m.lower(): m for m in ("Prophet", "SARIMA", "XGBoost", "RandomForest", "Hybrid")}
    if model.lower() not in known:
        raise ValueError(f"model must be one of {sorted(known)}")
    if not 1 <= periods <= 730:
        raise ValueError("periods must be between 1 and 730")
    if not 0.5 <= level <= 0.99:
        raise ValueError("level must be between 0.5 and 0.99")
    check = tune if use_tuning_data and tune is not None else train
    return run(train, check, keys, known[model.lower()], periods, level)


def combined_history(train: DataFrame, tune: DataFrame, keys=()) -> DataFrame:
    """Train and tune rows, the tune row where both have a day."""
    both = train.withColumn("_o", F.lit(0)).unionByName(tune.withColumn("_o", F.lit(1)))
    return S.keep_last(both, keys, "ds", ["_o"]).drop("_o")


def test_period(train: DataFrame, tune: DataFrame, test: DataFrame, keys=(), method: str = "Prophet", level: float = 0.95):
    """Forecast from the end of the history to the end of the test days.

    Series whose test days do not lie after their history get no rows. Needs the
    longest horizon as a number, one small aggregate.
    """
    history = combined_history(train, tune, keys)
    ends = history.groupBy(*keys).agg(F.max("ds").alias("_h"))
    days = attach(test.groupBy(*keys).agg(F.max("ds").alias("_t")), ends, keys)
    longest = days.agg(F.max(F.datediff("_t", "_h")).alias("n")).first()["n"] or 0
    if longest <= 0:
        return history.limit(0).select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in
                                               zip(COLUMNS, ("string", "date", "double", "double", "double", "boolean"))])
    out = run(history, history, keys, method, int(longest), level)["forecasts"].where(~F.col("is_history"))
    out = attach(out, days.select(*keys, "_t"), keys)
    return out.where(F.col("ds") <= F.col("_t")).drop("_t")


# ---------------------------------------------------------------- adaptive training


def adaptive(train: DataFrame, tune: DataFrame, keys=(), model: str = "Prophet", periods: int = 90):
    """Baseline, scale check and adaptation.

    A mean shift above ten percent rescales the forecasts; above one half the
    model is fitted again on rescaled train and tune together. Branches are per
    series and all run in the same jobs. Returns before / after accuracy on tune,
    the future forecasts after the tune end and the shift table.
    """
    keys = list(keys)
    both = train.withColumn("period", F.lit("train")).unionByName(tune.withColumn("period", F.lit("tune")), allowMissingColumns=True)
    shift = materialize(scale_shift(both, "y", "period", "train", "tune", keys).select(
        *keys, F.col("mean_ratio").alias("scale"), "requires_adjustment"), "shift")
    gap = attach(tune.groupBy(*keys).agg(F.max("ds").alias("_b")), train.groupBy(*keys).agg(F.max("ds").alias("_a")), keys)
    reach = int(gap.agg(F.max(F.datediff("_b", "_a")).alias("n")).first()["n"] or 0) + periods
    baseline = materialize(fit_models(train, keys, reach, 0.95, [model]), "baseline")
    rescaled = attach(train, shift, keys)
    again = (F.abs(F.col("scale") - 1) > 0.5) & F.col("requires_adjustment")
    refit_on = rescaled.withColumn("y", F.when(again, F.col("y") * F.col("scale")).otherwise(F.col("y"))).where(again)
    both_refit = combined_history(refit_on.select(*keys, "ds", "y"), attach(tune.select(*keys, "ds", "y"), shift, keys).where(again).select(*keys, "ds", "y"), keys)
    moved = attach(baseline, shift, keys)
    factor = F.when(F.col("requires_adjustment"), F.col("scale")).otherwise(1.0)
    kept = moved.where(~F.coalesce(again, F.lit(False))).select(
        *keys, "model", "ds", *[(F.col(c) * factor).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")], "is_history")
    both_refit = materialize(both_refit, "refit")
    adapted = kept if both_refit.isEmpty() else kept.unionByName(fit_models(both_refit, keys, periods, 0.95, [model]).select(*kept.columns))
    adapted = materialize(adapted, "adapted")
    before, after = E.accuracy(tune, baseline, keys), E.accuracy(tune, adapted, keys)
    metrics = before.withColumn("stage", F.lit("before")).unionByName(after.withColumn("stage", F.lit("after")))
    ends = tune.groupBy(*keys).agg(F.max("ds").alias("_b"))
    future = attach(adapted, ends, keys).where((F.col("ds") > F.col("_b")) & (F.col("ds") <= F.date_add("_b", periods))).drop("_b")
    return {"metrics": metrics, "future": future, "shift": shift, "adapted": adapted, "stability": E.stability(tune, adapted, keys)}


# ---------------------------------------------------------------- choice by cross-validation


def cross_validate(frame: DataFrame, keys=(), models=("Prophet", "SARIMA"), splits: int = 3) -> DataFrame:
    """Mean RMSE over expanding folds; every (series, fold) is one fit."""
    keys = list(keys)
    folds = S.cv_folds(frame.select(*keys, "ds", "y"), keys, "ds", splits)
    by = [*keys, "fold"]
    train, test = folds.where("role = 'train'").drop("role"), folds.where("role = 'test'").drop("role")
    longest = int(test.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"])
    # A fold continues right after its training days.
    fc = fit_models(train, by, longest, 0.95, list(models))
    scored = E.accuracy(test, fc.where(~F.col("is_history")), by, empty=float("inf"))
    return scored.groupBy(*keys, "model").agg(F.avg("rmse").alias("cv_rmse"))


def fold_weights(frame: DataFrame, keys=(), models=("Prophet", "SARIMA", "RandomForest"), splits: int = 3) -> DataFrame:
    """Weights per series and model that sum to one, by the inverse of the error on days that were not fitted."""
    keys = list(keys)
    scores = materialize(cross_validate(frame, keys, models, splits), "cv")
    known = scores.where(F.col("cv_rmse") < float("inf")).withColumn("_w", 1 / F.greatest(F.col("cv_rmse"), F.lit(1e-12)))
    return known.select(*keys, "model", "cv_rmse", (F.col("_w") / F.sum("_w").over(over(keys))).alias("weight"))  # a row for each model


def fitted_hybrid(frame: DataFrame, keys=(), periods: int = 90, models=("Prophet", "SARIMA", "RandomForest"), splits: int = 3) -> dict[str, DataFrame]:
    """The members fitted on all days and combined by their out-of-fold weights; bands of ten percent."""
    keys = list(keys)
    weights = materialize(fold_weights(frame, keys, models, splits), "weights")
    members = materialize(fit_models(frame, keys, periods, 0.95, list(models)), "members")
    joined = members.join(weights.drop("cv_rmse"), [*keys, "model"]).where(F.col("yhat").isNotNull())
    y = (F.sum(F.col("yhat") * F.col("weight")) / F.sum("weight")).alias("yhat")
    out = joined.groupBy(*keys, "ds", "is_history").agg(y)
    out = out.select(*keys, F.lit("Hybrid").alias("model"), "ds", "yhat", (F.col("yhat") * 0.9).alias("yhat_lower"), (F.col("yhat") * 1.1).alias("yhat_upper"), "is_history")
    return {"forecasts": out, "members": members, "weights": weights}


def auto_select(frame: DataFrame, keys=(), periods: int = 90, level: float = 0.95) -> dict[str, DataFrame]:
    """The model with the lowest cross-validated RMSE per series and its forecast.

    The seasonal ARIMA member uses the order with the lowest AIC; its bands are
    ten percent around the forecast.
    """
    keys = list(keys)
    scores = materialize(cross_validate(frame, keys), "cv")
    best = scores.groupBy(*keys).agg(F.min_by("model", F.struct("cv_rmse", "model")).alias("best_model"))
    orders = materialize(arima.best_orders(arima.search_orders(frame, keys), keys), "orders")
    sar = arima.forecast(frame, keys, periods, level, orders=orders, seasonal=(0, 0, 0, 0), history=True)
    add = additive.forecast(frame.select(*keys, "ds", "y"), keys, periods, level, change_scale=0.5)
    y = F.col("yhat")
    sar = sar.withColumns({"yhat_lower": y * 0.9, "yhat_upper": y * 1.1})
    table = attach(add.unionByName(sar), best, keys).where(F.col("model") == F.col("best_model")).drop("best_model")
    return {"scores": scores, "best": best, "forecasts": table, "orders": orders}
