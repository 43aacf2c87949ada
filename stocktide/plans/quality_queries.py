"""Validation and data quality."""

from pyspark.sql import functions as F

from stocktide.operators import clean as C
from stocktide.operators import quality as Q
from stocktide.operators.frames import attach
from stocktide.sources import tables as T

from .registry import query


def readings(spark, sf):
    return C.typed(T.raw_readings(spark, sf), "inventory", "dd/MM/yyyy")


@query("vq01_missing_columns", "level:s dataset:s column:s n_rows:l", """SELECT * FROM (VALUES ('full', 'inflows', 'Vendor_Address'),
 ('full', 'outflows', 'Partner_Address')) AS v(level, dataset, "column"), (SELECT count(*) AS n_rows FROM flows) AS c""")
def _(spark, sf):
    tables = {"inventory": T.inventory(spark, sf), "inflows": T.inflows(spark, sf), "outflows": T.outflows(spark, sf)}
    out = Q.missing_columns(spark, tables, "minimal")
    for level in ("medium", "full"):
        out = out.unionByName(Q.missing_columns(spark, tables, level))
    rows = T.flow_datasets(spark, sf, ["period"]).agg(F.count(F.lit(1)).alias("n_rows"))
    return attach(out, rows)


@query("vq02_row_rules", "dataset:s rule:s n:l", """SELECT 'readings' AS dataset, 'invalid_date' AS rule, count(*) FILTER (Date IS NULL) AS n FROM readings
 UNION ALL SELECT 'readings', 'level_not_numeric', count(*) FILTER (Inventory_Level IS NULL) FROM readings
 UNION ALL SELECT 'readings', 'level_negative', count(*) FILTER (Inventory_Level < 0) FROM readings
 UNION ALL SELECT 'inflows', 'invalid_date', count(*) FILTER (Date IS NULL) FROM inflows
 UNION ALL SELECT 'inflows', 'quantity_not_numeric', count(*) FILTER (Quantity IS NULL) FROM inflows
 UNION ALL SELECT 'inflows', 'quantity_not_positive', count(*) FILTER (Quantity <= 0) FROM inflows
 UNION ALL SELECT 'inflows', 'unit_value_extreme', count(*) FILTER (GIK_Per_Unit > 10000) FROM inflows""")
def _(spark, sf):
    r, i = readings(spark, sf), T.inflows(spark, sf, ["Date", "Quantity", "GIK_Per_Unit"])
    a = Q.count_rules(r, Q.row_rules(r)).withColumn("dataset", F.lit("readings"))
    return a.unionByName(Q.count_rules(i, Q.row_rules(i)).withColumn("dataset", F.lit("inflows")))


@query("vq03_required_periods", "type:s period:s present:b", """SELECT v.type, v.period, n > 0 AS present FROM (VALUES ('inventory', 'train'), ('inventory', 'tune')) AS v(type, period),
 LATERAL (SELECT count(*) AS n FROM inventory i WHERE i.period = v.period)""")
def _(spark, sf):
    stock = T.inventory(spark, sf).select(F.lit("inventory").alias("type"), "period")
    missing = Q.required_periods(stock).withColumn("present", F.lit(False))
    found = stock.distinct().where(F.col("period").isin("train", "tune")).withColumn("present", F.lit(True))
    return missing.unionByName(found)


@query("vq04_quality_issues", "issue:s n:l", """SELECT * FROM (SELECT 'duplicate_dates' AS issue, count(Date) - count(DISTINCT Date) AS n FROM readings
 UNION ALL SELECT 'missing_Date', count(*) FILTER (Date IS NULL) FROM readings
 UNION ALL SELECT 'missing_Inventory_Level', count(*) FILTER (Inventory_Level IS NULL) FROM readings) WHERE n > 0
 UNION ALL SELECT 'level_outliers', n FROM (SELECT count(*) FILTER (Inventory_Level < a OR Inventory_Level > b) AS n, count(*) AS m FROM readings,
 (SELECT quantile_cont(Inventory_Level, 0.01) AS a, quantile_cont(Inventory_Level, 0.99) AS b FROM readings)) WHERE n > 0.05 * m""")
def _(spark, sf):
    return Q.quality_issues(readings(spark, sf))


@query("vq05_preview", "Row_Id:s Date:s Quantity:d Product_Type:s", "SELECT Row_Id, Date, Quantity, Product_Type FROM inflows ORDER BY Date, Row_Id LIMIT 5")
def _(spark, sf):
    return Q.preview(T.inflows(spark, sf, ["Row_Id", "Date", "Quantity", "Product_Type"]), ["Date", "Row_Id"])


@query("vq05_preview_stats", "total:d mean:d median:d min:d max:d", """SELECT sum(Quantity) AS total, avg(Quantity) AS mean, quantile_cont(Quantity, 0.5) AS median,
 min(Quantity) AS min, max(Quantity) AS max FROM inflows""")
def _(spark, sf):
    q = T.inflows(spark, sf, ["Quantity"])
    v = F.col("Quantity")
    return attach(q.agg(F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")),
                  Q.quantiles(q, "Quantity", {"median": 0.5}))


def _describe_sql(table, cols):
    one = """SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev({c}) AS std, min({c}) AS min, max({c}) AS max,
 quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75 FROM {t}"""
    return " UNION ALL ".join(one.format(c=c, t=table) for c in cols)


_NUM = ["Quantity", "GIK_Per_Unit", "Total_GIK"]


@query("vq06_describe", "column:s count:l mean:d std:d min:d max:d p25:d p50:d p75:d", _describe_sql("inflows", _NUM))
def _(spark, sf):
    return Q.describe(T.inflows(spark, sf, _NUM))


@query("vq06_column_profile", "column:s type:s rows:l missing:l", """SELECT 'Date' AS "column", 'date' AS type, count(*) AS rows, count(*) FILTER (Date IS NULL) AS missing FROM readings
 UNION ALL SELECT 'Inventory_Level', 'double', count(*), count(*) FILTER (Inventory_Level IS NULL) FROM readings
 UNION ALL SELECT 'seq', 'bigint', count(*), 0 FROM readings""")
def _(spark, sf):
    return Q.column_profile(readings(spark, sf))


@query("vq06_date_span", "flow:s start:s end:s total_days:l", 'SELECT flow, min(Date) AS start, max(Date) AS "end", max(Date) - min(Date) AS total_days FROM flows GROUP BY 1')
def _(spark, sf):
    return Q.date_span(T.flow_datasets(spark, sf, ["Date"]), keys=["flow"])


def _flags_sql(table, cols):
    union = " UNION ALL ".join(f"SELECT '{c}' AS c, CAST({c} AS DOUBLE) AS v FROM {table} WHERE {c} IS NOT NULL" for c in cols)
    return f"""lg AS ({union}),
pr AS (SELECT c, avg(v) AS m, stddev_pop(v) AS sd, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.5) AS md FROM lg GROUP BY 1),
mm AS (SELECT c, quantile_cont(abs(v - md), 0.5) AS mad FROM lg JOIN pr USING (c) GROUP BY 1),
fl AS (SELECT c, v, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high, abs(v - m) > 3 * sd AS z, abs(0.6745 * (v - md)) > 3.5 * mad AS mz FROM lg JOIN pr USING (c) JOIN mm USING (c)),
oc AS (SELECT c, max(low) AS low, max(high) AS high, count(*) FILTER (v < low OR v > high) AS iqr, count(*) FILTER (z) AS zscore, count(*) FILTER (mz) AS modified_zscore,
 count(*) FILTER (v < low OR v > high OR z OR mz) AS total, count(*) FILTER (v < low OR v > high OR z OR mz) * 100.0 / count(*) AS percentage FROM fl GROUP BY 1)"""


@query("vq07_assessment", "metric:s subject:s value:d", f"""
WITH {_flags_sql('readings', ['Inventory_Level', 'seq'])}, mi AS (
 SELECT 'Date' AS c, count(*) FILTER (Date IS NULL) AS n, count(*) AS r FROM readings UNION ALL
 SELECT 'Inventory_Level', count(*) FILTER (Inventory_Level IS NULL), count(*) FROM readings UNION ALL SELECT 'seq', 0, count(*) FROM readings)
FINAL SELECT 'missing' AS metric, c AS subject, CAST(n AS DOUBLE) AS value FROM mi UNION ALL SELECT 'missing_pct', c, n * 100.0 / r FROM mi
UNION ALL SELECT 'columns_of_type', t, 1.0 FROM unnest(['date', 'double', 'bigint']) AS u(t)
UNION ALL SELECT 'duplicates', 'rows', (SELECT count(*) FROM readings) - (SELECT count(*) FROM (SELECT DISTINCT * FROM readings))
UNION ALL SELECT 'duplicates_pct', 'rows', 100.0 - 100.0 * (SELECT count(*) FROM (SELECT DISTINCT * FROM readings)) / (SELECT count(*) FROM readings)
UNION ALL SELECT 'outliers', c, total FROM oc UNION ALL SELECT 'outliers_pct', c, percentage FROM oc""")
def _(spark, sf):
    return Q.assessment(readings(spark, sf))


@query("vq07_duplicate_rows", "duplicates:l rows:l",
       "SELECT sum(n - 1) AS duplicates, sum(n) AS rows FROM (SELECT count(*) AS n FROM inflows GROUP BY Date, Quantity, Category, Warehouse)")
def _(spark, sf):
    return Q.duplicate_rows(T.inflows(spark, sf, ["Date", "Quantity", "Category", "Warehouse"]))


@query("vq08_consistency", "issue:s n:l", """SELECT * FROM (SELECT 'Inventory_Level_negative_values' AS issue, count(*) FILTER (Inventory_Level < 0) AS n FROM inventory
 UNION ALL SELECT 'Inventory_Level_extreme_values', count(*) FILTER (Inventory_Level > 1e6) FROM inventory
 UNION ALL SELECT 'future_dates', count(*) FILTER (Date > DATE '2000-06-30') FROM inventory) WHERE n > 0""")
def _(spark, sf):
    return Q.consistency(T.inventory(spark, sf), "2000-06-30")


@query("vq09_suggestions", "action:s subject:s", """
WITH mi AS (SELECT 'Date' AS c, count(*) FILTER (Date IS NULL) * 100.0 / count(*) AS p FROM readings UNION ALL
 SELECT 'Inventory_Level', count(*) FILTER (Inventory_Level IS NULL) * 100.0 / count(*) FROM readings)
FINAL SELECT CASE WHEN p > 50 THEN 'remove_column' ELSE 'impute_column' END AS action, c AS subject FROM mi WHERE p > 10
UNION ALL SELECT 'fix_consistency', 'future_dates' FROM (SELECT count(*) AS n FROM readings WHERE Date > DATE '2000-06-30') WHERE n > 0""")
def _(spark, sf):
    r = readings(spark, sf)
    return Q.suggestions(Q.assessment(r), Q.consistency(r, "2000-06-30"))


@query("vq10_gap_profile", "Series:s start:s end:s total_days:l data_points:l average_gap_days:l maximum_gap_days:l has_gaps:b", """
WITH g AS (SELECT Series, Date, Date - lag(Date) OVER (PARTITION BY Series ORDER BY Date, seq) AS gap FROM snapshots)
FINAL SELECT Series, min(Date) AS start, max(Date) AS "end", max(Date) - min(Date) AS total_days, count(*) AS data_points,
 CAST(floor(avg(gap)) AS BIGINT) AS average_gap_days, max(gap) AS maximum_gap_days, max(gap) > 1 AS has_gaps FROM g GROUP BY 1""")
def _(spark, sf):
    return Q.gap_profile(T.snapshots(spark, sf), ["Series"])


@query("vq11_processed_summary", "inventory_records:l inflows_records:l outflows_records:l start:s end:s mean:d std:d min:d max:d", """
SELECT (SELECT count(*) FROM inventory) AS inventory_records, (SELECT count(*) FROM inflows) AS inflows_records, (SELECT count(*) FROM outflows) AS outflows_records,
 least((SELECT min(Date) FROM inventory), (SELECT min(Date) FROM flows)) AS start, greatest((SELECT max(Date) FROM inventory), (SELECT max(Date) FROM flows)) AS "end",
 avg(Inventory_Level) AS mean, stddev(Inventory_Level) AS std, min(Inventory_Level) AS min, max(Inventory_Level) AS max FROM inventory""")
def _(spark, sf):
    return Q.processed_summary(T.inventory(spark, sf), T.inflows(spark, sf, ["Date"]), T.outflows(spark, sf, ["Date"]))
