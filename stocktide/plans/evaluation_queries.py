"""Forecast evaluation and combination on the two closed-form models."""

from pyspark.sql import functions as F

from stocktide.operators import evaluate as E
from stocktide.session import materialize

from .forecast_queries import FORECAST_SQL, K, period_frame, simple_forecasts, tune_levels
from .registry import query

_W = f"WITH {FORECAST_SQL}"


def scored(spark, sf):
    return E.accuracy(tune_levels(spark, sf), simple_forecasts(spark, sf), K)


@query("ev01_accuracy", "Series:s model:s rmse:d mae:d mape:d", f"{_W}\nFINAL SELECT * FROM mt")
def _(spark, sf):
    return scored(spark, sf)


_EXT = """ex AS (SELECT Series, model, y, yhat, e, CASE WHEN y <> 0 THEN abs(e / y) * 100 END AS pc,
 CAST((y - lag(y) OVER w > 0) = (yhat - lag(yhat) OVER w > 0) AS INTEGER) AS sm, y BETWEEN yhat_lower AND yhat_upper AS ins, yhat_upper - yhat_lower AS wd FROM cp WINDOW w AS (PARTITION BY Series, model ORDER BY ds)),
em AS (SELECT Series, model, avg(abs(e)) AS mae, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(pc) AS mape, quantile_cont(pc, 0.5) AS median_ape, avg(sm) * 100 AS direction_accuracy,
 1 - sum(e * e) / (var_pop(y) * count(y)) AS r_squared, avg(CAST(ins AS INTEGER)) * 100 AS coverage, avg(wd) AS avg_width FROM ex GROUP BY 1, 2)"""


@query("ev02_extended_accuracy", "Series:s model:s mae:d mse:d rmse:d mape:d median_ape:d direction_accuracy:d r_squared:d coverage:d avg_width:d",
       f"{_W}, {_EXT}\nFINAL SELECT * FROM em", places=3)
def _(spark, sf):
    return E.extended_accuracy(tune_levels(spark, sf), simple_forecasts(spark, sf), K)


@query("ev03_ratings", "Series:s model:s mape_rating:s fit_quality:s trend_prediction:s", f"""{_W}, {_EXT}
FINAL SELECT Series, model, CASE WHEN mape < 10 THEN 'Excellent' WHEN mape < 20 THEN 'Good' WHEN mape < 30 THEN 'Acceptable' ELSE 'Poor' END AS mape_rating,
 CASE WHEN r_squared > 0.9 THEN 'Excellent' WHEN r_squared > 0.7 THEN 'Good' WHEN r_squared > 0.5 THEN 'Moderate' ELSE 'Poor' END AS fit_quality,
 CASE WHEN direction_accuracy > 80 THEN 'Excellent' WHEN direction_accuracy > 60 THEN 'Good' WHEN direction_accuracy > 50 THEN 'Acceptable' ELSE 'Poor' END AS trend_prediction FROM em""")
def _(spark, sf):
    return E.ratings(E.extended_accuracy(tune_levels(spark, sf), simple_forecasts(spark, sf), K))


@query("ev04_actual_vs_predicted", "Series:s model:s ds:s Actual:d Predicted:d Error:d Absolute_Error:d Percentage_Error:d",
       f"{_W}\nFINAL SELECT Series, model, ds, y AS Actual, yhat AS Predicted, e AS Error, abs(e) AS Absolute_Error, e / sy * 100 AS Percentage_Error FROM cp WHERE ds > DATE '1997-12-31'", places=3)
def _(spark, sf):
    return E.compare(tune_levels(spark, sf), simple_forecasts(spark, sf), K, after=F.lit("1997-12-31").cast("date"))


@query("ev05_error_histogram", "Series:s model:s bin:l n:l", f"""{_W}, ed AS (SELECT Series, model, min(e) AS lo, max(e) AS hi FROM cp GROUP BY 1, 2)
FINAL SELECT Series, model, CAST(least(floor((e - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin, count(*) AS n FROM cp JOIN ed USING (Series, model) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return E.error_histogram(E.compare(tune_levels(spark, sf), simple_forecasts(spark, sf), K), ["Series", "model"])


@query("ev06_evaluate_on_tune", "Series:s model:s rmse:d mae:d mape:d missing:b", f"""{_W}, c2 AS (SELECT * FROM cp),
m2 AS (SELECT Series, model, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(abs(e / sy)) * 100 AS mape FROM c2 GROUP BY 1, 2)
FINAL SELECT Series, model, rmse, mae, mape, rmse IS NULL AS missing FROM (SELECT DISTINCT Series, model FROM fc) LEFT JOIN m2 USING (Series, model)""")
def _(spark, sf):
    # A series without actuals scores infinite, published here as missing.
    out = E.accuracy(tune_levels(spark, sf), simple_forecasts(spark, sf), K, empty=float("inf"))
    gone = F.col("rmse") == float("inf")
    return out.select("Series", "model", *[F.when(~gone, F.col(c)).alias(c) for c in ("rmse", "mae", "mape")], gone.alias("missing"))


@query("ev07_in_sample_accuracy", "Series:s model:s rmse:d mae:d mape:d", f"""{_W}, fi AS (SELECT Series, y - (m + sl * (i - (n - 1) / 2.0)) AS e, y FROM tf JOIN tm USING (Series) JOIN (SELECT Series, count(*) AS n FROM tf GROUP BY 1) USING (Series))
FINAL SELECT Series, 'Line' AS model, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(abs(e / y)) * 100 AS mape FROM fi GROUP BY 1""")
def _(spark, sf):
    from stocktide.operators.series import detrend

    frame = period_frame(spark, sf, "train")
    fit = detrend(frame, K, "ds", "y").select("Series", F.lit("Line").alias("model"), "ds", F.col("trend").alias("yhat"),
                                              F.col("trend").alias("yhat_lower"), F.col("trend").alias("yhat_upper"))
    return E.accuracy(frame, fit, K)


@query("ev08_stability", "Series:s model:s part:l rmse:d mae:d mape:d rmse_variance:d", f"""{_W},
sp AS (SELECT Series, ds, least((row_number() OVER (PARTITION BY Series ORDER BY ds) - 1) // (count(*) OVER (PARTITION BY Series) // 3), 2) AS part FROM tune_y),
pr AS (SELECT Series, model, part, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(abs(e / sy)) * 100 AS mape FROM cp JOIN sp USING (Series, ds) GROUP BY 1, 2, 3)
FINAL SELECT *, var_pop(rmse) OVER (PARTITION BY Series, model) AS rmse_variance FROM pr""", places=2)
def _(spark, sf):
    return E.stability(tune_levels(spark, sf), simple_forecasts(spark, sf), K)


@query("ev09_stability_report", "Series:s coverage_days:l scale_ratio:d scale_adaptation:s models:l consistency:s", f"""{_W},
a AS (SELECT Series, max(ds) - min(ds) AS d, avg(y) AS m FROM tf GROUP BY 1), b AS (SELECT Series, max(ds) - min(ds) AS d, avg(y) AS m FROM tune_y GROUP BY 1)
FINAL SELECT Series, a.d + b.d AS coverage_days, b.m / a.m AS scale_ratio, CASE WHEN b.m / a.m BETWEEN 0.8 AND 1.2 THEN 'Good' WHEN b.m / a.m BETWEEN 0.5 AND 2 THEN 'Moderate' ELSE 'Poor' END AS scale_adaptation,
 2 AS models, 'multiple' AS consistency FROM a JOIN b USING (Series)""")
def _(spark, sf):
    return E.stability_report(period_frame(spark, sf, "train"), tune_levels(spark, sf), simple_forecasts(spark, sf), K)


_CONF = """cb AS (SELECT Series, avg(y) AS bm, stddev(y) AS bs, max(ds) AS be FROM tf GROUP BY 1),
cf AS (SELECT Series, model, ds, greatest(0, 1 - (yhat_upper - yhat_lower) / abs(yhat) / 2) AS fi, greatest(0, 1 - (ds - be) / 180.0) AS fd2, greatest(0, 1 - mae / bm) AS fp, greatest(0, 1 - least(bs / bm, 1)) AS fst
 FROM fc JOIN cb USING (Series) JOIN mt USING (Series, model)),
cs AS (SELECT *, (0.3 * fi + 0.25 * fd2 + 0.25 * fp + 0.2 * fst) * 100 AS confidence FROM cf),
cc AS (SELECT *, CASE WHEN confidence >= 80 THEN 'High' WHEN confidence >= 60 THEN 'Medium' ELSE 'Low' END AS category FROM cs)"""


@query("ev10_confidence", "Series:s model:s ds:s confidence:d category:s interval:d distance:d performance:d stability:d",
       f"{_W}, {_CONF}\nFINAL SELECT *, fi * 100 AS interval, fd2 * 100 AS distance, fp * 100 AS performance, fst * 100 AS stability FROM cc")
def _(spark, sf):
    fc = simple_forecasts(spark, sf)
    out = E.confidence(fc, scored(spark, sf), period_frame(spark, sf, "train"), K)
    return out.select("*", "factors.*")


@query("ev10_confidence_summary", "Series:s model:s average_confidence:d high_days:l medium_days:l low_days:l",
       f"""{_W}, {_CONF}\nFINAL SELECT Series, model, avg(confidence) AS average_confidence, count(*) FILTER (category = 'High') AS high_days,
 count(*) FILTER (category = 'Medium') AS medium_days, count(*) FILTER (category = 'Low') AS low_days FROM cc GROUP BY 1, 2""")
def _(spark, sf):
    fc = simple_forecasts(spark, sf)
    return E.confidence_summary(E.confidence(fc, scored(spark, sf), period_frame(spark, sf, "train"), K), K)


_WT = "wt AS (SELECT *, exp(-mape / 10) / sum(exp(-mape / 10)) OVER (PARTITION BY Series) AS weight FROM mt)"


@query("ev11_ensemble", "method:s Series:s ds:s yhat:d yhat_lower:d yhat_upper:d", f"""{_W}, {_WT},
w3 AS (SELECT 'weighted' AS method, Series, model, weight FROM wt UNION ALL SELECT 'average', Series, model, 0.5 FROM wt
 UNION ALL SELECT 'best', Series, model, CAST(row_number() OVER (PARTITION BY Series ORDER BY weight DESC, model) = 1 AS INTEGER) FROM wt)
FINAL SELECT method, Series, ds, sum(yhat * weight) AS yhat, sum(yhat_lower * weight) AS yhat_lower, sum(yhat_upper * weight) AS yhat_upper FROM fc JOIN w3 USING (Series, model) GROUP BY 1, 2, 3""", places=3)
def _(spark, sf):
    fc = materialize(simple_forecasts(spark, sf), "forecasts")
    m = materialize(E.accuracy(tune_levels(spark, sf), fc, K), "metrics")
    weights = [E.ensemble_weights(m, K, how).withColumn("method", F.lit(how)) for how in ("weighted", "average", "best")]
    return E.ensemble(fc, weights[0].unionByName(weights[1]).unionByName(weights[2]), K, sets=["method"])


@query("ev11_ensemble_weights", "Series:s model:s weight:d", f"{_W}, {_WT}\nFINAL SELECT * FROM wt", places=8)
def _(spark, sf):
    return E.ensemble_weights(scored(spark, sf), K)


@query("ev12_ensemble_metrics", "Series:s rmse:d mae:d mape:d",
       f"{_W}, {_WT}\nFINAL SELECT Series, sum(rmse * weight) AS rmse, sum(mae * weight) AS mae, sum(mape * weight) AS mape FROM wt GROUP BY 1")
def _(spark, sf):
    return E.ensemble_metrics(E.ensemble_weights(scored(spark, sf), K), K)


@query("ev13_model_comparison", "Series:s model:s rmse:d mae:d mape:d rank:l", f"{_W}\nFINAL SELECT *, row_number() OVER (PARTITION BY Series ORDER BY mape, model) AS rank FROM mt")
def _(spark, sf):
    return E.comparison_table(scored(spark, sf), K)


@query("ev14_high_uncertainty", "Series:s uncertain:b", f"{_W}\nFINAL SELECT Series, bool_or(mape > 30) AS uncertain FROM mt GROUP BY 1")
def _(spark, sf):
    return E.high_uncertainty(scored(spark, sf), K)
