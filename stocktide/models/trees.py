"""Boosted trees and random forests over the features of all series.

Training is one distributed `pyspark.ml` fit over every series. The recursive
horizon takes many series through one day at a time with the fitted trees, whose
size is bounded by their number and depth.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktide.operators import series as S
from stocktide.operators.frames import attach, present, rows_of
from stocktide.session import enable_checkpoints, materialize, work_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = ["year", "month", "day", "dayofweek", "dayofyear", "quarter", "weekofyear", "lag_1", "lag_7", "rolling_mean_7", "rolling_std_7"]


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df)


def _scaled(frame: DataFrame, keys) -> DataFrame:
    """Each series relative to its own level, so one model serves all of them."""
    p = frame.groupBy(*keys).agg(F.avg("y").alias("_m"), F.coalesce(F.nullif(F.stddev("y"), F.lit(0.0)), F.lit(1.0)).alias("_s"))
    return attach(frame, p, keys)


def _lagged_rolling(rows: DataFrame, keys) -> DataFrame:
    """Rolling features of the rows before: a day's own level is what the model is to find."""
    before = lambda c: F.lag(c, 1).over(S.over(keys, "ds"))
    return rows.withColumns({c: before(c) for c in ("rolling_mean_7", "rolling_std_7")})


def _boosted_rows(frame: DataFrame, keys) -> DataFrame:
    rows = _scaled(frame, keys).withColumn("y", (F.col("y") - F.col("_m")) / F.col("_s"))
    return assembled(_lagged_rolling(S.training_features(rows, keys), keys), FEATURES)


def fit_boosted(frame: DataFrame, keys: Sequence[str], trees: int = 100, depth: int = 6, seed: int = 42):
    train = _boosted_rows(frame, keys).select("features", "y")
    model = GBTRegressor(featuresCol="features", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8,
                         featureSubsetStrategy="0.8", seed=seed, checkpointInterval=10)
    enable_checkpoints(frame.sparkSession)
    # Written once: each boosting round reads compact files, not the plan above.
    return model.fit(materialize(train, "training"))


def saved_nodes(model) -> DataFrame:
    """The nodes of a fitted model's trees as it saves them, one row each."""
    spark = SparkSession.active()
    path = work_path(spark, "trees")
    model.write().save(path)
    node = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"].alias("id"), node["split"]["featureIndex"].alias("feature"),
        F.coalesce(F.get(node["split"]["leftCategoriesOrThreshold"], 0), F.lit(0.0)).alias("cut"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["prediction"].alias("value"),
        node["gain"].alias("gain"), node["rawCount"].alias("rows"))


def node_tables(model) -> list[np.ndarray]:
    """Each tree as rows (feature or -1, threshold, left, right, value): at most trees x 2^(depth + 1) small rows."""
    table = saved_nodes(model).toPandas().sort_values(["treeID", "id"])
    table.loc[table["left"] < 0, "feature"] = -1
    return [g[["feature", "cut", "left", "right", "value"]].to_numpy(dtype=float) for _, g in table.groupby("treeID")]


def run_trees(tables, weights, x: np.ndarray) -> float:
    """The weighted sum of all trees for one row."""
    return float(Grove(tables, weights).predict(np.asarray(x, dtype=float)[None])[0])


class Grove:
    """All trees as one node table; rows go down all of them together, a level at a time."""

    def __init__(self, tables: Sequence[np.ndarray], weights: Sequence[float]):
        starts = np.cumsum([0, *map(len, tables)])
        self.roots, nodes = starts[:-1], np.concatenate(tables)
        shift = np.repeat(starts[:-1], [len(t) for t in tables])
        self.feature, self.cut, self.value = nodes[:, 0].astype(int), nodes[:, 1], nodes[:, 4]
        self.left, self.right = nodes[:, 2].astype(int) + shift, nodes[:, 3].astype(int) + shift
        self.weights = np.array(weights, dtype=float)

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return self.value[at] @ self.weights
            down = np.where(x[rows, np.maximum(feature, 0)] <= self.cut[at], self.left[at], self.right[at])
            at = np.where(inner, down, at)


LONGEST = 30  # days that a recursive horizon looks back


def _past(values: np.ndarray, days: int) -> np.ndarray:
    """The last `days` columns of the histories; days before a history are missing."""
    return values[:, -days:]


def _boosted_features(values: np.ndarray, day: pd.DatetimeIndex) -> np.ndarray:
    week = _past(values, 7)
    known = np.isfinite(week)
    n = known.sum(axis=1)
    mean = np.where(known, week, 0).sum(axis=1) / n
    spread = np.sqrt(np.where(known, (week - mean[:, None]) ** 2, 0).sum(axis=1) / np.maximum(1, n - 1))
    return np.column_stack([day.year, day.month, day.day, day.dayofweek, day.dayofyear, day.quarter, day.isocalendar().week.to_numpy(),
                            values[:, -1], values[:, -7], mean, spread]).astype(float)


def _forest_features(values: np.ndarray, day: pd.DatetimeIndex) -> np.ndarray:
    known = lambda a: np.where(np.isfinite(a), a, 0.0)
    full = lambda w: known(_past(values, w).mean(axis=1))  # missing unless all its days are there
    return np.column_stack([day.dayofweek, day.month, day.quarter, day.dayofyear, *(known(values[:, -k]) for k in (1, 7, 30)), full(7), full(30)]).astype(float)


def horizon(frame: DataFrame, keys: Sequence[str], periods: int, model, features, name: str, scaled: bool, least: int) -> DataFrame:
    """Recursive forecast: each day's prediction feeds the next day's features.

    A series is one row with its last days, so many of them take each day as one vectorised step and
    no series meets another in a group. Series with fewer than `least` days get days without a forecast.
    """
    keys = list(keys)
    shared = frame.sparkSession.sparkContext.broadcast((node_tables(model), [float(w) for w in model.treeWeights]))
    recent = frame.where(F.col("y").isNotNull()).withColumn("_r", F.row_number().over(S.over(keys, F.desc("ds")))).where(F.col("_r") <= LONGEST)
    lines = recent.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("_p"))  # at most LONGEST days
    sizes = _scaled(frame, keys).groupBy(*keys).agg(F.max("_m").alias("_m"), F.max("_s").alias("_s"), F.stddev("y").alias("_spread"))
    rows = attach(lines, sizes, keys).select(*keys, F.element_at("_p", -1)["ds"].alias("_last"), F.col("_p")["y"].alias("_y"), "_m", "_s", "_spread")

    def run(batches):
        grove = Grove(*shared.value)
        for batch in batches:
            for at in range(0, len(batch), 256):
                pdf = batch.iloc[at:at + 256].reset_index(drop=True)
                if not len(pdf):
                    continue
                mean, sd = (pdf["_m"].to_numpy(float), pdf["_s"].to_numpy(float)) if scaled else (np.zeros(len(pdf)), np.ones(len(pdf)))
                values = np.full((len(pdf), LONGEST), np.nan)
                for i, y in enumerate(pdf["_y"]):
                    values[i, LONGEST - len(y):] = (np.asarray(y, dtype=float) - mean[i]) / sd[i]
                short = np.isfinite(values).sum(axis=1) < least
                last, out, days = pd.DatetimeIndex(pd.to_datetime(pdf["_last"])), [], []
                for step in range(1, periods + 1):
                    day = last + pd.Timedelta(days=step)
                    new = np.where(short, np.nan, grove.predict(features(values, day)))
                    values = np.column_stack([values[:, 1:], new])
                    out.append(new)
                    days.append(day)
                y = np.array(out) * sd + mean
                half = 1.96 * np.nan_to_num(pdf["_spread"].to_numpy(float))
                for i in range(len(pdf)):
                    one = y[:, i]
                    yield pd.DataFrame({**{k: pdf[k].iloc[i] for k in keys}, "model": name, "ds": [d[i].date() for d in days],
                                        "yhat": one, "yhat_lower": one - half[i], "yhat_upper": one + half[i], "is_history": False})

    head = "".join(f"`{k}` {dict(frame.dtypes)[k]}, " for k in keys)
    found = rows.mapInPandas(run, head + "model string, ds date, yhat double, yhat_lower double, yhat_upper double, is_history boolean")
    missing = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return found.select(*keys, "model", "ds", *map(missing, ("yhat", "yhat_lower", "yhat_upper")), "is_history")


def forecast_boosted(frame: DataFrame, keys: Sequence[str], periods: int, model=None, name: str = "XGBoost", history: bool = False) -> DataFrame:
    """Boosted trees ahead, and with `history` their one-step rows; series of less than a week have no forecast."""
    frame = frame.select(*keys, "ds", "y")
    model = model or fit_boosted(frame, keys)
    ahead = horizon(frame, keys, periods, model, _boosted_features, name, True, 7)
    if not history:
        return ahead
    y = F.col("prediction") * F.col("_s") + F.col("_m")
    past = model.transform(_boosted_rows(frame, keys)).select(*keys, F.lit(name).alias("model"), "ds", y.alias("yhat"), y.alias("yhat_lower"), y.alias("yhat_upper"), F.lit(True).alias("is_history"))
    return past.unionByName(ahead)


# Feature names of the forest.
FOREST_FEATURES = ["DayOfWeek", "Month", "Quarter", "DayOfYear", "Inventory_Lag_1", "Inventory_Lag_7", "Inventory_Lag_30", "MA_7", "MA_30"]


def forest_features(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Calendar, lag and moving-average features of the days before; missing ones are zero."""
    cal = S.calendar_columns("ds")
    names = {"DayOfWeek": "dayofweek", "Month": "month", "Quarter": "quarter", "DayOfYear": "dayofyear"}
    out = frame.withColumns({k: cal[v].cast("double") for k, v in names.items()})
    out = S.lags(out, keys, "ds", "y", (1, 7, 30), "Inventory_Lag_")
    out = out.withColumns({f"MA_{w}": S.rolling(keys, "ds", "y", w)[f"rolling_mean_{w}"] for w in (7, 30)})
    out = out.withColumns({c: F.lag(c, 1).over(S.over(keys, "ds")) for c in ("MA_7", "MA_30")})
    return out.na.fill(0.0, [c for c in FOREST_FEATURES if c in out.columns])


def fit_forest(frame: DataFrame, keys: Sequence[str], trees: int = 100, depth: int = 10, seed: int = 42):
    """Returns the model and the feature columns it uses."""
    rows = forest_features(frame, keys)
    columns = [*present(rows, S.FEATURES[:4]), *FOREST_FEATURES]
    model = RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed)
    return model.fit(materialize(assembled(rows, columns).select("features", "y"), "training")), columns


def predict_forest(frame: DataFrame, keys: Sequence[str], model, columns, name: str = "RandomForest") -> DataFrame:
    """One-step predictions for the given rows."""
    out = model.transform(assembled(forest_features(frame, keys), columns))
    y = F.col("prediction")
    return out.select(*keys, F.lit(name).alias("model"), "ds", y.alias("yhat"), y.alias("yhat_lower"), y.alias("yhat_upper"))


def forecast_forest(frame: DataFrame, keys: Sequence[str], periods: int, name: str = "RandomForest", trees: int = 100, depth: int = 10) -> DataFrame:
    """Random forest: one-step rows of the history and a recursive horizon, without flow features (their future is not known)."""
    frame = frame.select(*keys, "ds", "y")
    model, columns = fit_forest(frame, keys, trees, depth)
    mean = _Averaged(model)
    past = predict_forest(frame, keys, model, columns, name).withColumn("is_history", F.lit(True))
    return past.unionByName(horizon(frame, keys, periods, mean, _forest_features, name, False, 1))


class _Averaged:
    """A forest with the weights of an average; the model itself weighs every tree with one."""

    def __init__(self, model):
        self.write, self.treeWeights = model.write, [1 / model.getNumTrees] * model.getNumTrees


def importances(spark, model, columns: Sequence[str]) -> DataFrame:
    """Feature names with their importance."""
    values = model.featureImportances.toArray()
    return rows_of(spark, [(c, float(v)) for c, v in zip(columns, values)], "feature string, importance double")


def gain_importances(model, columns: Sequence[str]) -> DataFrame:
    """Importance from the gains of the saved splits: rows times gain, shares of one in each tree, weighted by tree."""
    splits = saved_nodes(model).where("left >= 0").groupBy("treeID", "feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("_g"))
    shares = splits.withColumn("_share", F.col("_g") / F.sum("_g").over(S.over(["treeID"])))  # at most a row for each feature
    spark = splits.sparkSession
    weights = rows_of(spark, [(i, float(w)) for i, w in enumerate(model.treeWeights)], "treeID int, weight double")
    names = rows_of(spark, list(enumerate(columns)), "feature int, name string")
    by_feature = shares.join(weights, "treeID").groupBy("feature").agg(F.sum(F.col("_share") * F.col("weight")).alias("_w"))
    total = by_feature.agg(F.sum("_w").alias("w")).scalar()
    return names.join(by_feature, "feature", "left").select(F.col("name").alias("feature"), F.coalesce(F.col("_w") / total, F.lit(0.0)).alias("importance"))
