"""Models beside each other: trees in one step a day, fitted hybrids, adaptation of every model, importances."""

import datetime as dt
import functools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stocktide.models import arima, driver, simple, trees
from stocktide.operators import policy
from stocktide.operators import evaluate as E
from stocktide.operators import series as S


@pytest.fixture(scope="module")
def halves(frame):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(3):
        for i in range(500):
            y = 1000 + 0.5 * i + 40 * math.sin(2 * math.pi * i / 7) + rng.normal(0, 5) + 300 * k
            rows.append((f"s{k}", str(dt.date(2021, 1, 1) + dt.timedelta(days=i)), y))
    df = frame(rows, "k string, ds date, y double").cache()
    cut = F.lit("2022-04-01").cast("date")
    return df.where(F.col("ds") < cut).cache(), df.where(F.col("ds") >= cut).cache()


def walked(tables, weights, x):
    total = 0.0
    for nodes, w in zip(tables, weights):
        i = 0
        while nodes[i][0] >= 0:
            i = int(nodes[i][2] if x[int(nodes[i][0])] <= nodes[i][1] else nodes[i][3])
        total += w * nodes[i][4]
    return total


def test_horizon_equals_a_walk_of_each_series_by_itself(halves):
    train, _ = halves
    model = trees.fit_boosted(train, ["k"], trees=6, depth=4)
    tables, weights = trees.node_tables(model), list(model.treeWeights)
    got = {(r.k, r.ds): r.yhat for r in trees.forecast_boosted(train, ["k"], 12, model).collect()}
    for k, one in train.toPandas().groupby("k"):
        one = one.sort_values("ds")
        mean, sd = one["y"].mean(), one["y"].std()
        values = list((one["y"] - mean) / sd)
        for step in range(1, 13):
            day = pd.Timestamp(one["ds"].iloc[-1]) + pd.Timedelta(days=step)
            week = np.array(values[-7:])
            x = [day.year, day.month, day.day, day.dayofweek, day.dayofyear, day.quarter, day.isocalendar().week, values[-1], values[-7], week.mean(), week.std(ddof=1)]
            values.append(walked(tables, weights, x))
            assert got[k, day.date()] == pytest.approx(values[-1] * sd + mean, rel=1e-9)


def test_groves_add_all_trees():
    rng = np.random.default_rng(6)
    leaf = lambda v: [-1, 0, -1, -1, v]
    tables = [np.array([[0, 0.5, 1, 2, 0], leaf(1.0), [1, 0.2, 3, 4, 0], leaf(2.0), leaf(4.0)]), np.array([leaf(7.0)]), np.array([[1, 0.9, 1, 2, 0], leaf(0.5), leaf(-3.0)])]
    x = rng.random((50, 2))
    assert trees.Grove(tables, [1.0, 0.1, 2.0]).predict(x).tolist() == pytest.approx([walked(tables, [1.0, 0.1, 2.0], r) for r in x])


def test_short_series_have_days_without_a_forecast(halves, frame):
    train, _ = halves
    short = frame([("new", "2022-03-01", 5.0), ("new", "2022-03-02", 6.0)], "k string, ds date, y double")
    model = trees.fit_boosted(train, ["k"], trees=3, depth=3)
    got = trees.forecast_boosted(train.unionByName(short), ["k"], 4, model).collect()
    assert [r.yhat for r in got if r.k == "new"] == [None] * 4 and all(r.yhat is not None for r in got if r.k != "new")


@pytest.fixture
def small_trees(monkeypatch):
    monkeypatch.setattr(trees, "fit_boosted", functools.partial(trees.fit_boosted, trees=6, depth=3))


def test_every_model_has_in_sample_rows_and_scores(halves, small_trees):
    train, _ = halves
    for name in ("Prophet", "SARIMA", "XGBoost", "RandomForest", "Hybrid"):
        out = driver.run(train, train, ["k"], name, 5)
        scores = out["metrics"].collect()
        assert len(scores) == 3 and all(r.model == name and r.compared_days > 300 and 0 < r.rmse < 200 for r in scores)
        assert out["forecasts"].where(~F.col("is_history")).count() == 15


@pytest.mark.parametrize("model", ["Prophet", "SARIMA", "XGBoost", "RandomForest", "Hybrid"])
def test_every_model_adapts(halves, model, small_trees):
    train, test = halves
    out = driver.adaptive(train, test.withColumn("y", F.col("y") * F.when(F.col("k") == "s0", 2.0).otherwise(1.3)), ["k"], model, 10)
    scores = {(r.k, r.stage): r for r in out["metrics"].collect()}
    assert len(scores) == 6 and all(r.rmse is not None and r.compared_days > 0 for r in scores.values())
    assert all(scores[k, "after"].mae < scores[k, "before"].mae for k in ("s0", "s1", "s2"))
    parts = out["stability"].collect()
    assert len(parts) == 9 and all(r.rmse_variance is not None for r in parts)
    assert out["future"].count() == 30


def test_hybrid_by_out_of_fold_weights(halves):
    train, test = halves
    out = driver.fitted_hybrid(train, ["k"], 40, ("Prophet", "RandomForest"))
    sums = out["weights"].groupBy("k").agg(F.sum("weight").alias("w")).collect()
    assert len(sums) == 3 and all(r.w == pytest.approx(1.0) for r in sums)
    members = E.accuracy(test, out["members"].where(~F.col("is_history")), ["k"]).groupBy("k").agg(F.max("mae").alias("worse")).collect()
    mixed = {r.k: r.mae for r in E.accuracy(test, out["forecasts"].where(~F.col("is_history")), ["k"]).collect()}
    assert all(mixed[r.k] < r.worse for r in members)


def test_importances_of_both_models_sum_to_one(halves):
    train, _ = halves
    boosted = {r.feature: r.importance for r in trees.gain_importances(trees.fit_boosted(train, ["k"], trees=5, depth=3), trees.FEATURES).collect()}
    assert set(boosted) == set(trees.FEATURES) and sum(boosted.values()) == pytest.approx(1.0) and min(boosted.values()) >= 0
    assert max(boosted, key=boosted.get) in ("lag_1", "lag_7", "rolling_mean_7")


def test_forest_features_do_not_hold_their_own_day(frame):
    df = frame([("a", f"2022-01-{d:02d}", float(d)) for d in range(1, 12)], "k string, ds date, y double")
    got = {r.ds.day: r for r in trees.forest_features(df, ["k"]).collect()}
    assert got[8].MA_7 == 4.0 and got[9].MA_7 == 5.0 and got[7].MA_7 == 0.0 and got[9].Inventory_Lag_7 == 2.0


def test_hybrid_leaves_out_missing_members(frame):
    fc = frame([("A", "2022-01-01", None), ("B", "2022-01-01", 6.0)], "model string, ds date, yhat double")
    assert simple.hybrid(fc, [], {"A": 0.4, "B": 0.3}).first().yhat == 6.0


def test_one_short_series_is_reported(frame):
    df = frame([("2022-01-01", 1.0), ("2022-01-02", 2.0)], "ds date, y double")
    r = S.trend_change(df, [], "ds", "y").collect()
    assert [x.reason for x in r] == ["insufficient data"] and r[0].early_slope is None


def test_detrending_takes_the_smoothed_trend_where_it_can(frame):
    days = [str(dt.date(2022, 1, 1) + dt.timedelta(days=i)) for i in range(30)]
    rows = [("long", d, i + (5.0 if i % 7 == 0 else 0.0)) for i, d in enumerate(days)] + [("short", d, 2.0 * i) for i, d in enumerate(days[:9])]
    got = {(r.k, str(r.ds)): r for r in S.detrend_by_decomposition(frame(rows, "k string, ds date, y double"), ["k"], "ds", "y", 7).collect()}
    assert {r.method for (k, _), r in got.items() if k == "long"} == {"decomposition"} and {r.method for (k, _), r in got.items() if k == "short"} == {"line"}
    assert all(abs(r.detrended) < 1e-9 for (k, _), r in got.items() if k == "short")
    middle = [rows[i][2] for i in range(10, 17)]
    assert got["long", days[13]].trend == pytest.approx(sum(middle) / 7)
    assert got["long", days[0]].trend == got["long", days[3]].trend  # carried to the ends


def test_moments_of_a_cube_keep_small_spreads_of_large_values(frame):
    rows = [("outflows", "C", w, f"2022-01-{d:02d}", 1e9 + (d % 3) + (w == "B")) for d in range(1, 21) for w in "AB" for _ in range(2)]
    df = frame(rows, "flow string, Category string, Warehouse string, Date date, Quantity double")
    r = policy.category_spread(policy.daily_cube(df)).first()
    values = np.array([x[4] for x in rows])
    assert r._t == pytest.approx(values.sum()) and r._s == pytest.approx((values - 1e9).std(ddof=1), rel=1e-6)


def test_used_orders_name_what_a_short_series_lacks(frame):
    day = lambda i: dt.date(2023, 1, 1) + dt.timedelta(days=i)
    rows = [(k, day(i), float(i % 7)) for k, n in (("long", 59), ("brief", 58), ("short", 7)) for i in range(n)]
    df = frame([*rows, ("none", day(0), None)], "k string, ds date, y double")
    got = {r["k"]: (r["days"], r["p"], r["season"], r["reason"]) for r in arima.used_orders(df, ["k"]).collect()}
    assert got == {"long": (59, 1, 12, None), "brief": (58, 1, 0, "too short for the season"),
                   "short": (7, 0, 0, "too short for the order"), "none": (0, 0, 0, "too short for the order")}
    # Without a season asked for, none is missing.
    plain = arima.used_orders(df, ["k"], seasonal=(0, 0, 0, 0)).where("k = 'short' or k = 'brief'").orderBy("k").collect()
    assert [r["reason"] for r in plain] == [None, "too short for the order"]
