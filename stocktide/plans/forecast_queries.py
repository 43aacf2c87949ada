"""Forecast features, closed-form forecasts and fitted models."""

from pyspark.sql import functions as F

from stocktide.models import simple as M
from stocktide.operators import aggregates as A
from stocktide.operators import series as S
from stocktide.session import materialize
from stocktide.sources import tables as T

from .registry import query

K = ["Series"]


def period_frame(spark, sf, *periods):
    stock = T.inventory(spark, sf, by_priority=True).where(F.col("period").isin(*periods))
    return S.model_frame(stock, K)


def tune_levels(spark, sf):
    """Observed tune levels per series: Series, ds, y."""
    stock = T.inventory(spark, sf, by_priority=True).where("period = 'tune'")
    return stock.select("Series", F.col("Date").alias("ds"), F.col("Inventory_Level").alias("y"))


def with_horizon(frame):
    rule = M.horizon_rule(frame, K).select(*K, "horizon")
    return frame.join(rule, K)


def simple_forecasts(spark, sf):
    """Two closed-form models fitted on the train period of each series, which is written once."""
    frame = with_horizon(materialize(period_frame(spark, sf, "train"), "frame"))
    h = F.col("horizon")
    return M.naive_drift(frame, K, h).unionByName(M.mean_trend(frame, K, h))


# The same forecasts in SQL: fc (forecasts), tune_y (actuals), mt (accuracy).
FORECAST_SQL = """te AS (SELECT Series, min(Date) AS a, max(Date) AS b FROM stock WHERE period = 'train' GROUP BY 1),
tc AS (SELECT Series, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS ds FROM te),
tg AS (SELECT c.Series, c.ds, s.Inventory_Level AS v FROM tc c LEFT JOIN stock s ON s.Series = c.Series AND s.Date = c.ds),
tf AS (SELECT Series, ds, last_value(v IGNORE NULLS) OVER (PARTITION BY Series ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y,
 CAST(row_number() OVER (PARTITION BY Series ORDER BY ds) - 1 AS DOUBLE) AS i FROM tg),
tm AS (SELECT Series, arg_max(y, ds) AS ly, avg(y) AS m, stddev(y) AS sd, regr_slope(y, i) AS sl FROM tf GROUP BY 1),
th AS (SELECT Series, a, b, least(365, greatest(30, CAST(floor((b - a) * 0.25) AS BIGINT))) AS h FROM te),
fs AS (SELECT Series, b, h, unnest(generate_series(0, h - 1)) AS i FROM th),
fd AS (SELECT fs.*, CAST(b + CAST(i + 1 AS INTEGER) AS DATE) AS ds, ly + 0.01 * i * h / (h - 1) AS dr, m + sl * (i + 1) AS tr, 1.96 * sd * (1 + 0.5 * i / h) AS w FROM fs JOIN tm USING (Series)),
fc AS (SELECT Series, 'Drift' AS model, ds, dr AS yhat, dr * 0.95 AS yhat_lower, dr * 1.05 AS yhat_upper FROM fd
 UNION ALL SELECT Series, 'Trend', ds, tr, tr - w, tr + w FROM fd),
tune_y AS (SELECT Series, Date AS ds, Inventory_Level AS y FROM stock WHERE period = 'tune'),
cp AS (SELECT Series, model, ds, y, yhat, yhat_lower, yhat_upper, y - yhat AS e, CASE WHEN y <> 0 THEN y ELSE 1 END AS sy FROM fc JOIN tune_y USING (Series, ds)),
mt AS (SELECT Series, model, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(abs(e / sy)) * 100 AS mape FROM cp GROUP BY 1, 2)"""

_FC_OUT = "Series:s model:s ds:s yhat:d yhat_lower:d yhat_upper:d"


@query("fc06_training_features", "Series:s ds:s y:d year:l month:l day:l dayofweek:l dayofyear:l quarter:l weekofyear:l lag_1:d lag_7:d rolling_mean_7:d rolling_std_7:d", f"""
WITH {FORECAST_SQL}, ft AS (SELECT Series, ds, y, lag(y, 1) OVER w AS lag_1, lag(y, 7) OVER w AS lag_7, avg(y) OVER r AS rolling_mean_7, stddev(y) OVER r AS rolling_std_7 FROM tf
 WINDOW w AS (PARTITION BY Series ORDER BY ds), r AS (PARTITION BY Series ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
FINAL SELECT *, year(ds) AS year, month(ds) AS month, day(ds) AS day, isodow(ds) - 1 AS dayofweek, dayofyear(ds) AS dayofyear, quarter(ds) AS quarter, weekofyear(ds) AS weekofyear FROM ft WHERE lag_7 IS NOT NULL""", places=3)
def _(spark, sf):
    return S.training_features(period_frame(spark, sf, "train"), K)


@query("fc08_naive_drift", _FC_OUT, f"WITH {FORECAST_SQL}\nFINAL SELECT * FROM fc WHERE model = 'Drift'", places=3)
def _(spark, sf):
    frame = with_horizon(period_frame(spark, sf, "train"))
    return M.naive_drift(frame, K, F.col("horizon"))


@query("fc09_hybrid", _FC_OUT, f"""WITH {FORECAST_SQL}, hy AS (SELECT Series, ds, sum(yhat * CASE model WHEN 'Drift' THEN 0.4 ELSE 0.3 END) / 0.7 AS y FROM fc GROUP BY 1, 2)
FINAL SELECT Series, 'Hybrid' AS model, ds, y AS yhat, y * 0.9 AS yhat_lower, y * 1.1 AS yhat_upper FROM hy""", places=3)
def _(spark, sf):
    return M.hybrid(simple_forecasts(spark, sf), K, {"Drift": 0.4, "Trend": 0.3, "Absent": 0.3})


@query("fc12_volatility_bands", _FC_OUT, f"WITH {FORECAST_SQL}\nFINAL SELECT * FROM fc WHERE model = 'Trend'", places=3)
def _(spark, sf):
    frame = with_horizon(period_frame(spark, sf, "train"))
    return M.mean_trend(frame, K, F.col("horizon"))


@query("fc15_recommend_model", "Series:s data_points:l time_span_days:l variability_cv:d trend_strength:d Prophet:l SARIMA:l XGBoost:l recommended:s confidence:l", f"""
WITH {FORECAST_SQL}, fa AS (SELECT Series, count(*) AS n, CAST(max(ds) - min(ds) AS BIGINT) AS span, stddev(y) / avg(y) AS cv, abs(corr(y, i)) AS r FROM tf GROUP BY 1),
sc AS (SELECT *, CASE WHEN n >= 100 THEN 30 ELSE 0 END + CASE WHEN r > 0.5 THEN 25 ELSE 0 END + CASE WHEN span > 365 THEN 20 ELSE 0 END + CASE WHEN cv < 0.5 THEN 15 ELSE 0 END + 10 AS p,
 CASE WHEN n BETWEEN 50 AND 500 THEN 30 ELSE 0 END + CASE WHEN cv > 0.3 AND cv < 0.7 THEN 25 ELSE 0 END + CASE WHEN span >= 180 THEN 20 ELSE 0 END + 5 AS s,
 CASE WHEN n >= 50 THEN 30 ELSE 0 END + CASE WHEN cv > 0.5 THEN 25 ELSE 0 END + CASE WHEN r < 0.3 THEN 20 ELSE 0 END + 5 AS x FROM fa)
FINAL SELECT Series, n AS data_points, span AS time_span_days, cv AS variability_cv, r AS trend_strength, p AS "Prophet", s AS "SARIMA", x AS "XGBoost",
 CASE WHEN p >= s AND p >= x THEN 'Prophet' WHEN s >= x THEN 'SARIMA' ELSE 'XGBoost' END AS recommended, least(100, greatest(p, s, x)) AS confidence FROM sc""")
def _(spark, sf):
    return M.recommend(period_frame(spark, sf, "train"), K)


@query("fc16_horizon_rule", "Series:s span_days:l horizon:l", f"WITH {FORECAST_SQL}\nFINAL SELECT Series, b - a AS span_days, h AS horizon FROM th")
def _(spark, sf):
    return M.horizon_rule(period_frame(spark, sf, "train"), K)


@query("fc19_demand_outlook", "Category:s avg_daily_demand:d trend_slope:d forecast:d", """
WITH d AS (SELECT Category, Date, sum(Quantity) AS q FROM outflows GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY Category ORDER BY Date) - 1 AS i FROM d),
f AS (SELECT Category, avg(q) AS m, regr_slope(q, i) AS s FROM i GROUP BY 1 HAVING count(*) > 1)
FINAL SELECT Category, round_even(m, 2) AS avg_daily_demand, round_even(s, 3) AS trend_slope, greatest(0, round_even(m + 30 * s, 2)) AS forecast FROM f""")
def _(spark, sf):
    return M.demand_outlook(T.outflows(spark, sf, ["Category", "Date", "Quantity"]))


# ---------------------------------------------------------------- fitted models
# Their numbers are not SQL; shape and quality are tested instead of equality.

from stocktide.models import additive, arima, driver, trees  # noqa: E402

_FIT_OUT = _FC_OUT + " is_history:b"


def feature_frames(spark, sf):
    """Train and tune frames per series with the flow features."""
    cols = ["Date", "Quantity", "Warehouse", "Category"]
    fin, fout = T.inflows(spark, sf, cols), T.outflows(spark, sf, cols)
    feats = A.warehouse_features(fin, fout), A.category_features(fin, fout)
    return tuple(S.with_flow_features(period_frame(spark, sf, p), *feats) for p in ("train", "tune"))


@query("fc01_forecast_run", _FIT_OUT)
def _(spark, sf):
    train, tune = feature_frames(spark, sf)
    return driver.run(train, tune, K, "Both", 90)["forecasts"]


@query("fc01_run_accuracy", "Series:s model:s rmse:d mae:d mape:d")
def _(spark, sf):
    return driver.run(period_frame(spark, sf, "train"), period_frame(spark, sf, "tune"), K, "Both", 90)["metrics"]


@query("fc02_additive_model", _FIT_OUT)
def _(spark, sf):
    train, _tune = feature_frames(spark, sf)
    return additive.forecast(train, K, 90, regressors=S.FEATURES)


@query("fc03_seasonal_arima", _FIT_OUT)
def _(spark, sf):
    return arima.forecast(period_frame(spark, sf, "train"), K, 90)


@query("fc03_used_orders", "Series:s days:l p:l d:l q:l sp:l sd:l sq:l season:l reason:s", f"""WITH {FORECAST_SQL}, n AS (SELECT Series, count(y) AS n FROM tf GROUP BY 1)
FINAL SELECT Series, n AS days, CAST(n >= 8 AS INTEGER) AS p, CAST(n >= 8 AS INTEGER) AS d, CAST(n >= 8 AS INTEGER) AS q, CAST(n > 58 AS INTEGER) AS sp, CAST(n > 58 AS INTEGER) AS sd,
 CAST(n > 58 AS INTEGER) AS sq, CASE WHEN n > 58 THEN 12 ELSE 0 END AS season, CASE WHEN n < 8 THEN 'too short for the order' WHEN n <= 58 THEN 'too short for the season' END AS reason FROM n""")
def _(spark, sf):
    return arima.used_orders(period_frame(spark, sf, "train"), K)


@query("fc04_order_search", "Series:s p:l d:l q:l aic:d")
def _(spark, sf):
    return arima.best_orders(arima.search_orders(period_frame(spark, sf, "train"), K), K)


@query("fc05_boosted_trees", _FIT_OUT)
def _(spark, sf):
    return trees.forecast_boosted(period_frame(spark, sf, "train"), K, 90)


@query("fc07_random_forest", _FC_OUT)
def _(spark, sf):
    model, columns = trees.fit_forest(period_frame(spark, sf, "train"), K)
    return trees.predict_forest(period_frame(spark, sf, "tune"), K, model, columns)


@query("fc09_fitted_hybrid", _FIT_OUT)
def _(spark, sf):
    return driver.fitted_hybrid(period_frame(spark, sf, "train"), K, 90)["forecasts"]


@query("fc09_fold_weights", "Series:s model:s cv_rmse:d weight:d", places=6)
def _(spark, sf):
    return driver.fold_weights(period_frame(spark, sf, "train"), K)


@query("fc10_adaptive_stability", "Series:s model:s part:l rmse:d mae:d mape:d rmse_variance:d")
def _(spark, sf):
    return driver.adaptive(period_frame(spark, sf, "train"), period_frame(spark, sf, "tune"), K)["stability"]


@query("fc10_adaptive_hybrid", "Series:s model:s stage:s rmse:d mae:d mape:d")
def _(spark, sf):
    return driver.adaptive(period_frame(spark, sf, "train"), period_frame(spark, sf, "tune"), K, "Hybrid")["metrics"]


@query("fc10_adaptive_accuracy", "Series:s model:s stage:s rmse:d mae:d mape:d")
def _(spark, sf):
    return driver.adaptive(period_frame(spark, sf, "train"), period_frame(spark, sf, "tune"), K)["metrics"]


@query("fc11_adapted_forecast", _FIT_OUT)
def _(spark, sf):
    return driver.adaptive(period_frame(spark, sf, "train"), period_frame(spark, sf, "tune"), K)["future"]


@query("fc13_model_choice", "Series:s model:s cv_rmse:d")
def _(spark, sf):
    return driver.cross_validate(period_frame(spark, sf, "train"), K)


@query("fc14_chosen_forecast", _FIT_OUT)
def _(spark, sf):
    return driver.auto_select(period_frame(spark, sf, "train"), K)["forecasts"]


@query("fc17_test_period_forecast", _FIT_OUT)
def _(spark, sf):
    return driver.test_period(*(period_frame(spark, sf, p) for p in ("train", "tune", "test")), K)


@query("fc18_feature_importance", "feature:s importance:d", places=8)
def _(spark, sf):
    model, columns = trees.fit_forest(period_frame(spark, sf, "train"), K)
    return trees.importances(spark, model, columns)


@query("fc18_importance_by_model", "model:s feature:s importance:d", places=8)
def _(spark, sf):
    train = period_frame(spark, sf, "train")
    forest, columns = trees.fit_forest(train, K)
    boosted = trees.gain_importances(trees.fit_boosted(train, K), trees.FEATURES).withColumn("model", F.lit("XGBoost"))
    return trees.importances(spark, forest, columns).withColumn("model", F.lit("RandomForest")).unionByName(boosted)


@query("qa4_forecast_models", _FIT_OUT)
def _(spark, sf):
    """The request for every model, with in-sample rows and the days ahead."""
    train, tune = period_frame(spark, sf, "train"), period_frame(spark, sf, "tune")
    out = None
    for name in ("prophet", "sarima", "xgboost"):
        found = driver.request(train, tune, K, name, 60, 0.9)["forecasts"]
        out = found if out is None else out.unionByName(found)
    return out


@query("qa4_request_accuracy", "Series:s model:s rmse:d mae:d mape:d")
def _(spark, sf):
    """In-sample scores of a request without tuning data."""
    return driver.request(period_frame(spark, sf, "train"), None, K, "sarima", 60, 0.9, False)["metrics"]


@query("qa4_forecast_request", _FIT_OUT)
def _(spark, sf):
    out = driver.request(period_frame(spark, sf, "train"), period_frame(spark, sf, "tune"), K, "sarima", 60, 0.9)
    return out["forecasts"]
