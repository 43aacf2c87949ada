"""Outliers in levels and flows."""

from pyspark.sql import functions as F

from stocktide.models import isolation as I
from stocktide.operators import outliers as O
from stocktide.operators import quality as Q
from stocktide.sources import tables as T

from .registry import query

K, D, V = ["Series"], "Date", "Inventory_Level"


def stock(spark, sf):
    return T.inventory(spark, sf, by_priority=True)


_P = """pr AS (SELECT Series, avg(Inventory_Level) AS m, stddev_pop(Inventory_Level) AS sp, stddev(Inventory_Level) AS sd, quantile_cont(Inventory_Level, 0.25) AS q1,
 quantile_cont(Inventory_Level, 0.5) AS md, quantile_cont(Inventory_Level, 0.75) AS q3 FROM stock GROUP BY 1),
ma AS (SELECT Series, quantile_cont(abs(Inventory_Level - md), 0.5) AS mad FROM stock JOIN pr USING (Series) GROUP BY 1),
fl AS (SELECT *, abs(Inventory_Level - m) / sp AS z, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, 0.6745 * abs(Inventory_Level - md) / mad AS mz FROM stock JOIN pr USING (Series) JOIN ma USING (Series))"""


@query("od01_fence_outliers", "Series:s Date:s Inventory_Level:d low:d high:d", f"WITH {_P}\nFINAL SELECT Series, Date, Inventory_Level, lo AS low, hi AS high FROM fl WHERE Inventory_Level < lo OR Inventory_Level > hi")
def _(spark, sf):
    return O.fence_rows(stock(spark, sf), V, K)


@query("od02_zscore_outliers", "Series:s Date:s Inventory_Level:d score:d", f"WITH {_P}\nFINAL SELECT Series, Date, Inventory_Level, z AS score FROM fl WHERE z > 3")
def _(spark, sf):
    return O.zscore_rows(stock(spark, sf), V, K)


@query("od03_modified_zscore_outliers", "Series:s Date:s Inventory_Level:d score:d", f"WITH {_P}\nFINAL SELECT Series, Date, Inventory_Level, mz AS score FROM fl WHERE mz > 3.5")
def _(spark, sf):
    return O.modified_zscore_rows(stock(spark, sf), V, K)


@query("od03_value_outliers", "flow:s Date:s Product_Type:s Brand:s Total_GIK:d score:d", """
WITH m AS (SELECT flow, quantile_cont(Total_GIK, 0.5) AS md FROM flows GROUP BY 1), a AS (SELECT flow, quantile_cont(abs(Total_GIK - md), 0.5) AS mad FROM flows JOIN m USING (flow) GROUP BY 1)
FINAL SELECT flow, Date, Product_Type, Brand, Total_GIK, 0.6745 * abs(Total_GIK - md) / mad AS score FROM flows JOIN m USING (flow) JOIN a USING (flow) WHERE 0.6745 * abs(Total_GIK - md) / mad > 1.2""")
def _(spark, sf):
    # Values are near uniform here, so a limit of 1.2 shows the tail.
    flows = T.flow_datasets(spark, sf, ["Date", "Product_Type", "Brand", "Total_GIK"])
    return O.modified_zscore_rows(flows, "Total_GIK", ["flow"], limit=1.2)


@query("od04_method_counts", "Series:s low:d high:d iqr:l zscore:l modified_zscore:l total:l percentage:d", f"""WITH {_P}
FINAL SELECT Series, max(lo) AS low, max(hi) AS high, count(*) FILTER (Inventory_Level < lo OR Inventory_Level > hi) AS iqr, count(*) FILTER (z > 3) AS zscore, count(*) FILTER (mz > 3.5) AS modified_zscore,
 count(*) FILTER (Inventory_Level < lo OR Inventory_Level > hi OR z > 3 OR mz > 3.5) AS total, count(*) FILTER (Inventory_Level < lo OR Inventory_Level > hi OR z > 3 OR mz > 3.5) * 100.0 / count(*) AS percentage FROM fl GROUP BY 1""")
def _(spark, sf):
    return Q.outlier_counts(stock(spark, sf), [V], K)


_DS = """ds AS (SELECT period || '_inventory' AS dataset, 'Inventory_Level' AS "column", CAST(Date AS VARCHAR) AS row, Date, Inventory_Level AS v FROM inventory WHERE period IN ('train', 'tune')
 UNION ALL SELECT period || '_' || flow, 'Quantity', Row_Id, Date, Quantity FROM flows WHERE period IN ('train', 'tune') AND NOT (period = 'train' AND flow = 'outflows')
 UNION ALL SELECT period || '_' || flow, 'Total_GIK', Row_Id, Date, Total_GIK FROM flows WHERE period IN ('train', 'tune') AND flow = 'inflows'),
dp AS (SELECT dataset, "column", quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, avg(v) AS m, stddev_pop(v) AS s FROM ds GROUP BY 1, 2),
df AS (SELECT ds.*, v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a) AS i, abs(v - m) > 3 * s AS z FROM ds JOIN dp USING (dataset, "column")),
dr AS (SELECT dataset, "column", row, Date, v AS value, CASE WHEN i AND z THEN 'IQR,Z-Score' WHEN i THEN 'IQR' ELSE 'Z-Score' END AS methods FROM df WHERE i OR z)"""


def measured(spark, sf, dims=("Category", "Brand", "Warehouse")):
    """Levels, and flows with everything the detection run reads; `dims` are joined only where label drift needs them."""
    columns = ["period", "Row_Id", "Date", "Quantity", "Total_GIK", *dims]
    return T.inventory(spark, sf), T.flow_datasets(spark, sf, columns)


# The queries with an oracle take fences and z-scores alone; those named `three_methods`, at the end, run the whole detection.
@query("od06_flagged_rows", "dataset:s column:s row:s Date:s value:d methods:s", f"WITH {_DS}\nFINAL SELECT * FROM dr")
def _(spark, sf):
    return O.flagged_datasets(*measured(spark, sf, dims=()), trees=False).withColumn("methods", F.concat_ws(",", "detection_methods"))


_AN = f"""{_P}, un AS (SELECT Series, Date, Inventory_Level, z AS score, 1 AS p, 'Statistical_Outlier' AS kind FROM fl WHERE z > 3
 UNION ALL SELECT Series, Date, Inventory_Level, abs(Inventory_Level - md) / sd, 2, 'IQR_Outlier' FROM fl WHERE Inventory_Level < lo OR Inventory_Level > hi),
an AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Series, Date ORDER BY p) AS r FROM un) WHERE r = 1)"""


@query("od07_series_anomalies", "Series:s Date:s Inventory_Level:d kind:s score:d", f"WITH {_AN}\nFINAL SELECT * FROM an")
def _(spark, sf):
    return O.series_anomalies(stock(spark, sf), K)


_FEAT = ["Inventory_Level", "DayOfYear", "Month", "Quarter", "Rolling_Mean_7", "Rolling_Std_7", "Rolling_Mean_30", "Inventory_Lag1", "Inventory_Lag7"]
_BF = "coalesce({c}, first_value({c} IGNORE NULLS) OVER (PARTITION BY Series ORDER BY Date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"


@query("od08_anomaly_features", "Series:s Date:s " + " ".join(f"{c}:d" for c in _FEAT), f"""
WITH f AS (SELECT Series, Date, Inventory_Level, dayofyear(Date) AS DayOfYear, month(Date) AS Month, quarter(Date) AS Quarter,
 CASE WHEN count(*) OVER w7 = 7 THEN avg(Inventory_Level) OVER w7 END AS Rolling_Mean_7, CASE WHEN count(*) OVER w7 = 7 THEN stddev(Inventory_Level) OVER w7 END AS Rolling_Std_7,
 CASE WHEN count(*) OVER w30 = 30 THEN avg(Inventory_Level) OVER w30 END AS Rolling_Mean_30, lag(Inventory_Level) OVER o AS Inventory_Lag1, lag(Inventory_Level, 7) OVER o AS Inventory_Lag7 FROM stock
 WINDOW o AS (PARTITION BY Series ORDER BY Date), w7 AS (PARTITION BY Series ORDER BY Date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY Series ORDER BY Date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
g AS (SELECT Series, Date, {', '.join(_BF.format(c=c) for c in _FEAT)} FROM f)
FINAL SELECT Series, Date, {', '.join(f'({c} - avg({c}) OVER p) / stddev_pop({c}) OVER p AS {c}' for c in _FEAT)} FROM g WINDOW p AS (PARTITION BY Series)""")
def _(spark, sf):
    return O.anomaly_features(stock(spark, sf), K)


@query("od10_score_bands", "total:l high:l medium:l low:l", f"WITH {_AN}\nFINAL SELECT count(*) AS total, count(*) FILTER (score > 5) AS high, count(*) FILTER (score > 3 AND score <= 5) AS medium, count(*) FILTER (score <= 3) AS low FROM an")
def _(spark, sf):
    return O.score_bands(O.series_anomalies(stock(spark, sf), K))


from .statistics_queries import _BINS, _DIMS, _DRIFT, _LONG3, _share_sql  # noqa: E402


@query("od09_summary", "total_outliers:l drift_severity:s scale_severity:s", f"""WITH {_DS}, {_LONG3}, {_BINS},
sr AS (SELECT greatest(abs(1 - avg(v) FILTER (period = 'tune') / avg(v) FILTER (period = 'train')), CASE WHEN "column" = 'inventory' THEN abs(1 - stddev(v) FILTER (period = 'tune') / stddev(v) FILTER (period = 'train')) ELSE 0 END) AS r FROM lg WHERE "column" <> 'gik' GROUP BY "column")
FINAL SELECT (SELECT count(*) FROM dr) AS total_outliers, (SELECT CASE WHEN max(js) > 0.5 THEN 'High' WHEN max(js) > 0.2 THEN 'Medium' ELSE 'Low' END FROM js) AS drift_severity,
 (SELECT CASE WHEN max(r) > 0.5 THEN 'High' WHEN max(r) > 0.2 THEN 'Medium' ELSE 'Low' END FROM sr) AS scale_severity""")
def _(spark, sf):
    return O.detect(*measured(spark, sf), trees=False)["summary"]


@query("od11_detection_run", "section:s subject:s value:d", f"""WITH {_DS.replace("dr AS (", "fr AS (")}, {_LONG3}, {_BINS}, {_share_sql(_DIMS)}, {_DRIFT}
FINAL SELECT 'outliers' AS section, dataset || '|' || "column" || '|' || methods AS subject, CAST(count(*) AS DOUBLE) AS value FROM fr GROUP BY 2
UNION ALL SELECT 'drift', "column", js FROM js UNION ALL SELECT 'label_drift', lower(dimension), total_variation FROM dr
UNION ALL SELECT 'shift', CASE "column" WHEN 'inventory' THEN 'inventory_mean' ELSE 'inflow_quantity' END, avg(v) FILTER (period = 'tune') / avg(v) FILTER (period = 'train') FROM lg WHERE "column" <> 'gik' GROUP BY 2
UNION ALL SELECT 'shift', 'inventory_std', stddev(v) FILTER (period = 'tune') / stddev(v) FILTER (period = 'train') FROM lg WHERE "column" = 'inventory'
UNION ALL SELECT 'summary', 'total_outliers', count(*) FROM fr""")
def _(spark, sf):
    return O.detection_rows(O.detect(*measured(spark, sf), trees=False))


# Trees are random by design; these run without an oracle.
@query("od05_isolation_forest", "Row_Id:s Total_GIK:d anomaly_score:d", places=8)
def _(spark, sf):
    return I.isolation_outliers(T.inflows(spark, sf, ["Row_Id", "Total_GIK"]), "Row_Id", ["Total_GIK"])


def pattern_anomalies(spark, sf):
    feats = O.anomaly_features(stock(spark, sf), K).withColumn("_row", F.concat_ws("|", "Series", "Date"))
    hits = I.isolation_outliers(feats, "_row", O.FEATURE_COLUMNS, min_rows=50).select("Series", "Date", F.col("anomaly_score").alias("score"))
    return hits.join(stock(spark, sf).select("Series", "Date", V), ["Series", "Date"])


@query("od05_isolation_forest_patterns", "Series:s Date:s Inventory_Level:d score:d", places=8)
def _(spark, sf):
    return pattern_anomalies(spark, sf)


@query("od11_full_run", "Series:s Date:s Inventory_Level:d kind:s score:d", places=8)
def _(spark, sf):
    return O.series_anomalies(stock(spark, sf), K, patterns=pattern_anomalies(spark, sf))


@query("od06_flagged_rows_three_methods", "dataset:s column:s row:s Date:s value:d methods:s")
def _(spark, sf):
    return O.flagged_datasets(*measured(spark, sf, dims=())).withColumn("methods", F.concat_ws(",", "detection_methods"))


@query("od09_summary_three_methods", "total_outliers:l drift_severity:s scale_severity:s")
def _(spark, sf):
    return O.detect(*measured(spark, sf))["summary"]


@query("od11_detection_run_three_methods", "section:s subject:s value:d")
def _(spark, sf):
    return O.detection_rows(O.detect(*measured(spark, sf)))
