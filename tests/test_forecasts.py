import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stocktide.models import additive, arima, driver, simple, trees
from stocktide.operators import alerts as L
from stocktide.operators import evaluate as E
from stocktide.operators import policy as P
from stocktide.operators.frames import rows_of

FC = "model string, ds date, yhat double, yhat_lower double, yhat_upper double"


@pytest.fixture
def pair(frame):
    actual = frame([("2023-01-01", 10.0), ("2023-01-02", 0.0), ("2023-01-03", 20.0), ("2023-01-09", 5.0)], "ds date, y double")
    fc = frame([("A", "2023-01-01", 12.0, 9.0, 13.0), ("A", "2023-01-02", 1.0, -1.0, 2.0), ("A", "2023-01-03", 18.0, 21.0, 25.0),
                ("B", "2023-01-03", 25.0, 15.0, 30.0), ("C", "2023-05-01", 1.0, 0.0, 2.0)], FC)
    return actual, fc


def test_accuracy_divides_by_one_on_zero_and_scores_no_overlap(pair):
    got = {r.model: r for r in E.accuracy(*pair).collect()}
    assert got["A"].mae == pytest.approx(5 / 3) and got["A"].rmse == pytest.approx(math.sqrt(3))
    assert got["A"].mape == pytest.approx((20 + 100 + 10) / 3)
    assert (got["C"].rmse, got["C"].mae, got["C"].mape) == (0.0, 0.0, 0.0)
    worst = {r.model: r.rmse for r in E.accuracy(*pair, empty=float("inf")).collect()}
    assert worst["C"] == float("inf")


def test_extended_accuracy_leaves_out_zero_actuals(pair):
    r = {x.model: x for x in E.extended_accuracy(*pair).collect()}["A"]
    assert r.mape == pytest.approx(15.0) and r.median_ape == pytest.approx(15.0)
    assert r.direction_accuracy == 100.0 and r.coverage == pytest.approx(200 / 3)


def test_ensemble_weights_sum_to_one_and_dates_may_be_missing(pair, frame):
    fc = pair[1].where("model <> 'C'")
    m = frame([("A", 1.0, 1.0, 10.0), ("B", 3.0, 3.0, None)], "model string, rmse double, mae double, mape double")
    w = {r.model: r.weight for r in E.ensemble_weights(m).collect()}
    assert sum(w.values()) == pytest.approx(1.0) and w["B"] / w["A"] == pytest.approx(math.e)
    out = {str(r.ds): r.yhat for r in E.ensemble(fc, E.ensemble_weights(m)).collect()}
    assert out["2023-01-01"] == pytest.approx(12.0)
    assert out["2023-01-03"] == pytest.approx(w["A"] * 18 + w["B"] * 25)
    assert E.ensemble_weights(m.where("model = 'A'")).count() == 0
    best = {r.model: r.weight for r in E.ensemble_weights(m, method="best").collect()}
    assert best == {"A": 0.0, "B": 1.0}


def test_confidence_counts_days_from_the_last_training_day(frame):
    train = frame([("2022-12-30", 100.0), ("2022-12-31", 100.0)], "ds date, y double")
    fc = frame([("A", "2023-01-01", 100.0, 90.0, 110.0), ("A", "2023-06-29", 0.0, -1.0, 1.0)], FC)
    m = frame([("A", 10.0)], "model string, mae double")
    a, b = E.confidence(fc, m, train).orderBy("ds").collect()
    assert a.factors.interval == pytest.approx(90) and a.factors.distance == pytest.approx(100 * (1 - 1 / 180))
    assert a.factors.performance == pytest.approx(90) and a.factors.stability == pytest.approx(100) and a.category == "High"
    assert b.factors.interval == pytest.approx(50) and b.factors.distance == 0.0


def test_naive_drift_and_horizon(frame):
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(101)]
    f = frame([(str(d), float(i)) for i, d in enumerate(days)], "ds date, y double")
    assert simple.horizon_rule(f).first().horizon == 30
    got = simple.naive_drift(f, [], 3).orderBy("ds").collect()
    assert [r.yhat for r in got] == pytest.approx([100.0, 100.015, 100.03])
    assert str(got[0].ds) == "2023-04-12" and got[0].yhat_lower == pytest.approx(95.0)
    assert simple.recommend(f).first().recommended == "Prophet"


def test_policy_fold_by_hand(spark, frame):
    """Level 100, demand 10 a day, order 50 at 80 or below, lead 2 days, safety 60."""
    fc = frame([("A", f"2023-01-{d:02d}", 1000.0, 0.0, 0.0) for d in range(1, 8)], FC)
    sc = rows_of(spark, [("s", 80.0, 60.0, 2, 50.0, 100.0)], P.SCENARIO)
    got = P.project(fc, sc).orderBy("ds").collect()
    assert [r.inventory_level for r in got] == [90, 80, 70, 60, 100, 90, 80]
    assert [r.pending for r in got] == [False, False, True, True, False, False, False]
    assert [r.stockout for r in got] == [False] * 7
    m = P.scenario_metrics(P.project(fc, sc)).first()
    assert (m.stockout_days, m.pending_days, m.pending_spells, m.service_level) == (0, 2, 1, 100.0)
    # The emergency order is placed when the safety stock is broken first.
    urgent = rows_of(spark, [("s", 0.0, 85.0, 3, 20.0, 100.0)], P.SCENARIO)
    rows = P.project(fc, urgent).orderBy("ds").collect()
    assert [r.inventory_level for r in rows] == [90, 80, 70, 60, 70, 60, 50]
    assert [r.stockout for r in rows] == [False] + [True] * 6


def test_forecast_alerts_and_advice(frame):
    fc = frame([("A", "2023-01-01", 4.0, 0.0, 0.0), ("A", "2023-01-02", 14.0, 0.0, 0.0), ("A", "2023-01-03", 260.0, 0.0, 0.0),
                ("A", "2023-03-01", 1.0, 0.0, 0.0), ("A", "2022-12-31", 1.0, 0.0, 0.0)], FC)
    base = frame([(100.0,)], "average double")
    al = L.forecast_alerts(fc, base, "2023-01-01")
    assert [(r.date, r.kind, r.severity) for r in al.orderBy("date").collect()] == [
        ("2023-01-01", "critical", "critical"), ("2023-01-02", "stockout", "warning"), ("2023-01-03", "overstock", "warning")]
    assert {r.advice for r in L.alert_advice(L.alert_summary(al)).collect()} == {"expedite_procurement", "dynamic_reorder_policy"}
    assert [r.advice for r in L.alert_advice(L.alert_summary(al.limit(0))).collect()] == ["stable"]


def seasonal(frame, keys=3, years=3):
    rng = np.random.default_rng(1)
    rows = []
    start = dt.date(2020, 1, 1)
    for k in range(keys):
        for i in range(365 * years):
            d = start + dt.timedelta(days=i)
            y = 1000 + 0.3 * i + 60 * math.sin(2 * math.pi * i / 365.25) + 40 * math.sin(2 * math.pi * i / 7) + rng.normal(0, 5) + 100 * k
            rows.append((f"s{k}", str(d), y))
    return frame(rows, "k string, ds date, y double")


@pytest.fixture(scope="module")
def halves(frame):
    df = seasonal(frame).cache()
    cut = F.lit("2022-10-01").cast("date")
    return df.where(F.col("ds") < cut).cache(), df.where(F.col("ds") >= cut).cache()


def check_shape(fc, keys, periods):
    future = fc.where(~F.col("is_history"))
    assert future.count() == keys * periods
    assert future.where("yhat_lower > yhat or yhat > yhat_upper or yhat is null").count() == 0


def mae(test, fc):
    return {r.k: r.mae for r in E.accuracy(test, fc.where(~F.col("is_history")), ["k"]).collect()}


def naive_mae(train, test):
    flat = simple.naive_drift(train, ["k"], 60).withColumn("is_history", F.lit(False))
    return mae(test, flat)


def test_additive_model_beats_the_naive_forecast(halves):
    train, test = halves
    fc = additive.forecast(train, ["k"], 60)
    check_shape(fc, 3, 60)
    got, base = mae(test, fc), naive_mae(train, test)
    assert all(got[k] < 0.6 * base[k] for k in base)


def test_arima_forecasts_follow_trend_and_widen(halves):
    train, test = halves
    fc = arima.forecast(train, ["k"], 60).cache()
    check_shape(fc, 3, 60)
    w = fc.orderBy("ds").where("k = 's0'").selectExpr("yhat_upper - yhat_lower as w").collect()
    assert w[-1].w > w[0].w
    got, base = mae(test, fc), naive_mae(train, test)
    assert all(got[k] < 2 * base[k] for k in base)


def test_arima_recovers_an_autoregression():
    rng = np.random.default_rng(5)
    y = np.zeros(1500)
    for t in range(1, 1500):
        y[t] = 0.7 * y[t - 1] + rng.normal()
    theta, _, _ = arima.fit(y, (1, 0, 0), (0, 0, 0, 0))
    assert theta[0] == pytest.approx(0.7, abs=0.05)
    e = rng.normal(size=2000)
    theta, _, _ = arima.fit(e[1:] + 0.5 * e[:-1], (0, 0, 1), (0, 0, 0, 0))
    assert theta[0] == pytest.approx(0.5, abs=0.06)


def test_boosted_trees_small_model(halves):
    train, _ = halves
    model = trees.fit_boosted(train, ["k"], trees=8, depth=4)
    tables = trees.node_tables(model)
    assert len(tables) == 8
    # The exported nodes predict what the fitted model predicts.
    x = [2021.0, 3.0, 1.0, 2.0, 60.0, 1.0, 9.0, 0.3, -0.2, 0.1, 0.4]
    from pyspark.ml.linalg import Vectors

    assert trees.run_trees(tables, model.treeWeights, np.array(x)) == pytest.approx(model.predict(Vectors.dense(x)))
    check_shape(trees.forecast_boosted(train, ["k"], 10, model), 3, 10)


def test_random_forest_importance(halves, spark):
    train, test = halves
    model, columns = trees.fit_forest(train, ["k"], trees=5, depth=5)
    imp = trees.importances(spark, model, columns).collect()
    assert len(imp) == 9 and sum(r.importance for r in imp) == pytest.approx(1.0)
    assert trees.predict_forest(test, ["k"], model, columns).count() == test.count()


def test_run_scores_in_data_units(halves):
    train, test = halves
    out = driver.run(train, test, ["k"], "Prophet", 60)
    check_shape(out["forecasts"], 3, 60)
    m = {r.k: r for r in out["metrics"].collect()}
    assert all(1 < m[k].rmse < 200 and m[k].mape < 10 for k in m)
    assert out["confidence"].count() == 180 and out["stability"].first().consistency == "single"


def test_one_series_needs_no_key(halves):
    train, test = halves
    one = train.where("k = 's1'").drop("k")
    assert additive.forecast(one, [], 5).where("not is_history").count() == 5
    assert arima.forecast(one, [], 5).count() == 5


def test_test_period_reaches_the_last_test_day(halves):
    train, test = halves
    cut = F.lit("2022-11-01").cast("date")
    fc = driver.test_period(train, test.where(F.col("ds") < cut), test.where(F.col("ds") >= cut), ["k"])
    ends = fc.groupBy("k").agg(F.min("ds").alias("a"), F.max("ds").alias("b")).collect()
    last = test.agg(F.max("ds")).first()[0]
    assert all((str(r.a), r.b) == ("2022-11-01", last) for r in ends)
    assert driver.test_period(train, test, train, ["k"]).count() == 0


def test_adaptation_lowers_the_error_after_a_scale_shift(halves):
    train, test = halves
    doubled = test.withColumn("y", F.col("y") * 2)
    out = driver.adaptive(train, doubled, ["k"], "SARIMA", 30)
    m = {(r.k, r.stage): r.mae for r in out["metrics"].collect()}
    assert out["shift"].where("requires_adjustment").count() == 3
    assert out["future"].count() == 90
    assert all(m["s0", s] >= 0 for s in ("before", "after"))
    mild = driver.adaptive(train, test.withColumn("y", F.col("y") * 1.3), ["k"], "SARIMA", 30)
    m = {(r.k, r.stage): r.mae for r in mild["metrics"].collect()}
    assert all(m[k, "after"] < m[k, "before"] for k in ("s0", "s1", "s2"))


def test_request_limits():
    for bad in ({"periods": 0}, {"periods": 731}, {"level": 0.4}, {"model": "oracle"}):
        with pytest.raises(ValueError):
            driver.request(None, None, **bad)
