"""Grouped summaries over the driver's tables."""

from pyspark.sql import functions as F

from stocktide.operators import aggregates as A
from stocktide.operators import outliers, series
from stocktide.operators.frames import only
from stocktide.sources import tables as T

from .registry import query

_DIVERSITY = "1.0 - 1.0 / count(*)"


def _feature_sql(dim):
    return f"""
WITH fin AS (SELECT Date, {dim} AS k, sum(Quantity) AS qi FROM inflows GROUP BY 1, 2),
fout AS (SELECT Date, {dim} AS k, sum(Quantity) AS qo FROM outflows GROUP BY 1, 2),
m AS (SELECT Date, k, coalesce(qi, 0) AS qi, coalesce(qo, 0) AS qo FROM fin FULL JOIN fout USING (Date, k))
FINAL SELECT Date, sum(qi) AS total_in, sum(qo) AS total_out, count(DISTINCT k) AS active,
 {_DIVERSITY} AS diversity, 1 - sum((qi + qo) * (qi + qo)) / (sum(qi + qo) * sum(qi + qo)) AS simpson
FROM m GROUP BY Date"""


def _features(make, names):
    def build(spark, sf):
        dim = "Warehouse" if names is A.WAREHOUSE_NAMES else "Category"
        cols = ["Date", "Quantity", dim]
        f = make(T.inflows(spark, sf, cols), T.outflows(spark, sf, cols))
        return f.select(
            "Date", F.col(names["in"]).alias("total_in"), F.col(names["out"]).alias("total_out"),
            F.col(names["active"]).alias("active"), F.col(names["diversity"]).alias("diversity"),
            F.col(names["simpson"]).alias("simpson"),
        )

    return build


_FEATURE_OUT = "Date:s total_in:d total_out:d active:l diversity:d simpson:d"
query("ag01_daily_warehouse_features", _FEATURE_OUT, _feature_sql("Warehouse"))(
    _features(A.warehouse_features, A.WAREHOUSE_NAMES))
query("ag02_daily_category_features", _FEATURE_OUT, _feature_sql("Category"))(
    _features(A.category_features, A.CATEGORY_NAMES))

_DIST_OUT = ("{k}count:l mean:d median:d std:d min:d max:d range:d q1:d q3:d iqr:d skewness:d kurtosis:d "
             "cv:d p5:d p10:d p90:d p95:d p99:d")


def _dist_sql(source, value, key=None):
    q = lambda p: f"quantile_cont({value}, {p})"
    k = f"{key}, " if key else ""
    g = f"GROUP BY {key}" if key else ""
    return f"""SELECT {k}count({value}) AS count, avg({value}) AS mean, {q(0.5)} AS median, stddev({value}) AS std,
 min({value}) AS min, max({value}) AS max, max({value}) - min({value}) AS range, {q(0.25)} AS q1, {q(0.75)} AS q3,
 {q(0.75)} - {q(0.25)} AS iqr, skewness({value}) AS skewness, kurtosis({value}) AS kurtosis,
 stddev({value}) / avg({value}) AS cv, {q(0.05)} AS p5, {q(0.1)} AS p10, {q(0.9)} AS p90, {q(0.95)} AS p95,
 {q(0.99)} AS p99 FROM {source} {g}"""


@query("ag03_level_distribution_by_period", _DIST_OUT.format(k="period:s "), _dist_sql("inventory", "Inventory_Level", "period"))
def _(spark, sf):
    return A.distribution(T.inventory(spark, sf), "Inventory_Level", ["period"])


@query("ag03_value_distribution", _DIST_OUT.format(k=""), _dist_sql("inflows", "Total_GIK"))
def _(spark, sf):
    return A.distribution(T.inflows(spark, sf, ["Total_GIK"]), "Total_GIK")


@query("ag04_label_counts", "flow:s Brand:s n:l share:d",
       "SELECT flow, Brand, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY flow) AS share FROM flows GROUP BY 1, 2")
def _(spark, sf):
    return A.label_counts(T.flow_datasets(spark, sf, ["Brand"]), "Brand", ["flow"])


@query("ag04_top_vendors", "Vendor:s n:l",
       "SELECT Vendor, count(*) AS n FROM inflows GROUP BY 1 ORDER BY n DESC, Vendor LIMIT 10")
def _(spark, sf):
    return A.top_labels(A.label_counts(T.inflows(spark, sf, ["Vendor"]), "Vendor"), "Vendor", 10)


@query("ag05_value_by_category", "Category:s mean:d median:d total:d n:l",
       "SELECT Category, avg(Total_GIK) AS mean, quantile_cont(Total_GIK, 0.5) AS median, sum(Total_GIK) AS total, count(*) AS n FROM inflows GROUP BY 1")
def _(spark, sf):
    return A.value_by(T.inflows(spark, sf, ["Category", "Total_GIK"]), "Category")


def _performance_sql(dim):
    side = lambda f, t: f"""coalesce(sum(Quantity) FILTER (flow = '{f}'), 0) AS {t}_sum,
 avg(Quantity) FILTER (flow = '{f}') AS {t}_mean, count(*) FILTER (flow = '{f}') AS {t}_count,
 coalesce(sum(Total_GIK) FILTER (flow = '{f}'), 0) AS {t}_value"""
    return f"SELECT *, in_sum - out_sum AS net_flow FROM (SELECT {dim}, {side('inflows', 'in')}, {side('outflows', 'out')} FROM flows GROUP BY 1)"


_PERF_OUT = "{k}:s in_sum:d in_mean:d in_count:l in_value:d out_sum:d out_mean:d out_count:l out_value:d net_flow:d"


@query("ag06_category_performance", _PERF_OUT.format(k="Category"), _performance_sql("Category"))
def _(spark, sf):
    return A.flow_performance(T.flow_datasets(spark, sf, ["Category", "Quantity", "Total_GIK"]), "Category")


@query("ag07_warehouse_performance", _PERF_OUT.format(k="Warehouse"), _performance_sql("Warehouse"))
def _(spark, sf):
    return A.flow_performance(T.flow_datasets(spark, sf, ["Warehouse", "Quantity", "Total_GIK"]), "Warehouse")


@query("ag08_quantity_by_category", "period:s Category:s sum:d mean:d count:l",
       "SELECT period, Category, sum(Quantity) AS sum, avg(Quantity) AS mean, count(*) AS count FROM flows GROUP BY 1, 2")
def _(spark, sf):
    flows = T.flow_datasets(spark, sf, ["period", "Category", "Quantity"])
    return flows.groupBy("period", "Category").agg(
        F.sum("Quantity").alias("sum"), F.avg("Quantity").alias("mean"), F.count("Quantity").alias("count"))


@query("ag09_dimension_facts", "kind:s dataset:s Row_Id:s Date:s label:s Quantity:d Total_GIK:d",
       """SELECT k AS kind, period || '_' || flow AS dataset, Row_Id, Date,
 CASE k WHEN 'Category' THEN Category WHEN 'Brand' THEN Brand ELSE Warehouse END AS label, Quantity,
 CASE WHEN k <> 'Category' THEN Total_GIK END AS Total_GIK
 FROM flows, unnest(['Category', 'Brand', 'Warehouse']) AS u(k)""")
def _(spark, sf):
    flows = T.flow_datasets(spark, sf, ["Row_Id", "Date", "Category", "Brand", "Warehouse", "Quantity", "Total_GIK", "period"])
    tagged = flows.withColumn("dataset", F.concat_ws("_", "period", "flow"))
    facts = tagged.select("dataset", "Row_Id", "Date", "Quantity", "Total_GIK", "Category", "Brand", "Warehouse").unpivot(
        ["dataset", "Row_Id", "Date", "Quantity", "Total_GIK"], ["Category", "Brand", "Warehouse"], "kind", "label")
    return facts.withColumn("Total_GIK", F.when(F.col("kind") != "Category", F.col("Total_GIK")))


@query("ag10_level_patterns", "period:s grain:s bucket:s mean_level:d",
       """SELECT period, 'month' AS grain, CAST(month(Date) AS VARCHAR) AS bucket, avg(Inventory_Level) AS mean_level FROM inventory GROUP BY ALL
 UNION ALL SELECT period, 'quarter', CAST(quarter(Date) AS VARCHAR), avg(Inventory_Level) FROM inventory GROUP BY ALL
 UNION ALL SELECT period, 'weekday', dayname(Date), avg(Inventory_Level) FROM inventory GROUP BY ALL
 UNION ALL SELECT period, 'year', CAST(year(Date) AS VARCHAR), avg(Inventory_Level) FROM inventory GROUP BY ALL""")
def _(spark, sf):
    return A.level_patterns(T.inventory(spark, sf), ["period"])


@query("ag11_flow_patterns", "flow:s period:s grain:s bucket:s total:d",
       """SELECT flow, period, 'month' AS grain, CAST(month(Date) AS VARCHAR) AS bucket, sum(Quantity) AS total FROM flows GROUP BY ALL
 UNION ALL SELECT flow, period, 'quarter', CAST(quarter(Date) AS VARCHAR), sum(Quantity) FROM flows GROUP BY ALL""")
def _(spark, sf):
    return A.flow_patterns(T.flow_datasets(spark, sf, ["Date", "Quantity", "period"]), ["flow", "period"])


def label_sql(rate):
    """The turnover bands as a SQL expression."""
    cases = " ".join(f"WHEN {rate} > {bound} THEN '{text}'" for bound, text in A.TURNOVER_BANDS)
    return f"CASE {cases} ELSE '{A.TURNOVER_REST}' END"


@query("ag12_turnover", "basis:s avg_inventory:d total_outflows:d turnover:d days_of_stock:d label:s", f"""
WITH s AS (SELECT avg(Inventory_Level) AS a, count(*) AS n, CAST(max(Date) - min(Date) AS DOUBLE) AS span FROM inventory WHERE period = 'tune'),
o AS (SELECT sum(Quantity) AS q FROM outflows WHERE period = 'tune'),
t AS (SELECT basis, a AS avg_inventory, q AS total_outflows, span,
 q * (CASE basis WHEN 'raw' THEN 1.0 WHEN 'rows' THEN 365.0 / n ELSE 365.0 / span END) / a AS turnover
 FROM s, o, unnest(['raw', 'rows', 'span']) AS u(basis))
FINAL SELECT *, (CASE basis WHEN 'raw' THEN span ELSE 365.0 END) / turnover AS days_of_stock, {label_sql('turnover')} AS label FROM t""", places=8)
def _(spark, sf):
    stock = T.inventory(spark, sf).where("period = 'tune'")
    out = T.outflows(spark, sf, ["Quantity", "period"]).where("period = 'tune'")
    raw, rows, span = (A.turnover(stock, out, b) for b in ("raw", "rows", "span"))
    return raw.unionByName(rows).unionByName(span)


@query("ag13_flow_balance", "total_inflows:d total_outflows:d net_change:d flow_ratio:d",
       """SELECT *, total_inflows - total_outflows AS net_change, total_inflows / total_outflows AS flow_ratio FROM (
 SELECT sum(Quantity) FILTER (flow = 'inflows') AS total_inflows, sum(Quantity) FILTER (flow = 'outflows') AS total_outflows FROM flows)""")
def _(spark, sf):
    return A.flow_balance(T.flow_datasets(spark, sf, ["Quantity"]))


@query("ag13_monthly_flows", "month:s inflow:d outflow:d",
       """SELECT strftime(Date, '%Y-%m') AS month, sum(Quantity) FILTER (flow = 'inflows') AS inflow,
 sum(Quantity) FILTER (flow = 'outflows') AS outflow FROM flows GROUP BY 1""")
def _(spark, sf):
    return A.monthly_flows(T.flow_datasets(spark, sf, ["Date", "Quantity"]))


@query("ag14_partner_volumes", "Partner:s total_quantity:d shipment_count:l avg_shipment:d rank:l",
       """SELECT *, rank() OVER (ORDER BY total_quantity DESC) AS rank FROM (
 SELECT Partner, sum(Quantity) AS total_quantity, count(*) AS shipment_count, avg(Quantity) AS avg_shipment FROM outflows GROUP BY 1)""")
def _(spark, sf):
    return A.partner_volumes(T.outflows(spark, sf, ["Partner", "Quantity"]))


@query("ag14_partner_overview", "partners:l shipments:l total_quantity:d avg_shipment:d",
       "SELECT count(DISTINCT Partner) AS partners, count(*) AS shipments, sum(Quantity) AS total_quantity, avg(Quantity) AS avg_shipment FROM outflows")
def _(spark, sf):
    return A.partner_overview(T.outflows(spark, sf, ["Partner", "Quantity"]))


@query("ag15_partner_trend", "grain:s bucket:s quantity:d",
       """SELECT 'month' AS grain, strftime(Date, '%Y-%m') AS bucket, sum(Quantity) AS quantity FROM outflows GROUP BY ALL
 UNION ALL SELECT 'day', strftime(Date, '%Y-%m-%d'), sum(Quantity) FROM outflows GROUP BY ALL""")
def _(spark, sf):
    out = T.outflows(spark, sf, ["Date", "Quantity"])
    month = A.partner_trend(out).withColumn("grain", F.lit("month"))
    return month.unionByName(A.partner_trend(out, grain="day").withColumn("grain", F.lit("day")))


@query("ag15_partner_comparison", "month:s Partner:s quantity:d",
       """SELECT strftime(Date, '%Y-%m') AS month, Partner, sum(Quantity) AS quantity FROM outflows WHERE Partner IN (
 SELECT Partner FROM outflows GROUP BY 1 ORDER BY sum(Quantity) DESC, Partner LIMIT 3) GROUP BY ALL""")
def _(spark, sf):
    out = T.outflows(spark, sf, ["Date", "Partner", "Quantity"])
    leaders = out.groupBy("Partner").agg(F.sum("Quantity").alias("q")).orderBy(F.desc("q"), "Partner").limit(3)
    return A.partner_comparison(out, leaders)


@query("ag16_partner_metrics", "Partner:s shipments:l quantity:d avg_size:d total_gik:d total_ei:d",
       """SELECT Partner, count(*) AS shipments, sum(Quantity) AS quantity, avg(Quantity) AS avg_size,
 sum(Total_GIK) AS total_gik, sum(Total_EI) AS total_ei FROM outflows GROUP BY 1""")
def _(spark, sf):
    return A.partner_metrics(T.outflows(spark, sf, ["Partner", "Quantity", "Total_GIK", "Total_EI"]))


@query("ag17_period_summary", "type:s period:s records:l avg:d min:d max:d total:d total_gik:d",
       """SELECT 'inventory' AS type, period, count(*) AS records, avg(Inventory_Level) AS avg, min(Inventory_Level) AS min,
 max(Inventory_Level) AS max, NULL AS total, NULL AS total_gik FROM inventory GROUP BY period
 UNION ALL SELECT flow, period, count(*), avg(Quantity), NULL, NULL, sum(Quantity), sum(Total_GIK) FROM flows GROUP BY flow, period""")
def _(spark, sf):
    return A.period_summary(T.inventory(spark, sf), T.flow_datasets(spark, sf, ["period", "Quantity", "Total_GIK"]))


@query("ag18_performance", "average_level:d peak_level:d minimum_level:d variation:d total_volume:d average_size:d donations:l",
       """SELECT * FROM (SELECT avg(Inventory_Level) AS average_level, max(Inventory_Level) AS peak_level, min(Inventory_Level) AS minimum_level,
 stddev(Inventory_Level) / avg(Inventory_Level) AS variation FROM inventory WHERE period = 'tune'),
 (SELECT sum(Quantity) AS total_volume, avg(Quantity) AS average_size, count(*) AS donations FROM inflows WHERE period = 'tune')""")
def _(spark, sf):
    return A.performance(T.inventory(spark, sf).where("period = 'tune'"),
                         T.inflows(spark, sf, ["period", "Quantity"]).where("period = 'tune'"))


@query("ag19_level_baseline", "average:d median:d std:d min:d max:d",
       """SELECT avg(Inventory_Level) AS average, quantile_cont(Inventory_Level, 0.5) AS median, stddev_pop(Inventory_Level) AS std,
 min(Inventory_Level) AS min, max(Inventory_Level) AS max FROM inventory WHERE period IN ('train', 'tune')""")
def _(spark, sf):
    return A.baseline(T.inventory(spark, sf).where("period in ('train', 'tune')"))


@query("ag20_category_insights", "Category:s tune_value:d tune_avg:d tune_volume:l train_value:d train_avg:d train_volume:l top_brands:s volume_growth:d value_growth:d", """
WITH c AS (SELECT Category, sum(Total_GIK) FILTER (period = 'tune') AS tune_value, avg(Total_GIK) FILTER (period = 'tune') AS tune_avg,
 count(*) FILTER (period = 'tune') AS tune_volume, sum(Total_GIK) FILTER (period = 'train') AS train_value,
 avg(Total_GIK) FILTER (period = 'train') AS train_avg, count(*) FILTER (period = 'train') AS train_volume
 FROM inflows WHERE period IN ('tune', 'train') GROUP BY 1),
b AS (SELECT Category, Brand, row_number() OVER (PARTITION BY Category ORDER BY count(*) DESC, Brand) AS r
 FROM inflows WHERE period = 'tune' GROUP BY 1, 2),
t AS (SELECT Category, string_agg(Brand, ',' ORDER BY r) AS top_brands FROM b WHERE r <= 3 GROUP BY 1)
FINAL SELECT c.*, top_brands, (tune_volume - train_volume) * 100.0 / train_volume AS volume_growth,
 (tune_avg - train_avg) * 100.0 / train_avg AS value_growth FROM c LEFT JOIN t USING (Category)""")
def _(spark, sf):
    return A.category_insights(T.inflows(spark, sf, ["Category", "Brand", "Total_GIK", "period"]))


@query("ag21_dominant_category", "Category:s percentage:d",
       """SELECT Category, n * 100.0 / t AS percentage FROM (SELECT Category, count(*) AS n, sum(count(*)) OVER () AS t FROM inflows
 WHERE period = 'tune' GROUP BY 1) ORDER BY n DESC, Category DESC LIMIT 1""")
def _(spark, sf):
    return A.dominant_label(T.inflows(spark, sf, ["Category", "period"]).where("period = 'tune'"), "Category")


@query("ag22_key_metrics", "avg_inventory:d peak_inventory:d min_inventory:d inventory_volatility:d turnover_rate:d days_of_stock:d", """
WITH p AS (SELECT *, Inventory_Level / lag(Inventory_Level) OVER (ORDER BY Date) - 1 AS ch FROM inventory),
o AS (SELECT sum(Quantity) AS q FROM outflows),
k AS (SELECT avg(Inventory_Level) AS avg_inventory, max(Inventory_Level) AS peak_inventory, min(Inventory_Level) AS min_inventory,
 stddev(ch) AS inventory_volatility, CAST(max(Date) - min(Date) AS DOUBLE) AS span FROM p)
FINAL SELECT *, q * 365.0 / span / avg_inventory AS turnover_rate, 365.0 / (q * 365.0 / span / avg_inventory) AS days_of_stock FROM k, o""", places=6)
def _(spark, sf):
    stock = T.inventory(spark, sf)
    return A.key_metrics(series.level_trends(stock), A.turnover(stock, T.outflows(spark, sf, ["Quantity"])))


@query("ag23_dimension_values", "dimension:s value:s",
       "SELECT DISTINCT 'Warehouse' AS dimension, Warehouse AS value FROM flows UNION ALL SELECT DISTINCT 'Category', Category FROM flows")
def _(spark, sf):
    return A.distinct_labels(T.flow_datasets(spark, sf, ["Warehouse", "Category"]), ["Warehouse", "Category"])


@query("ag24_period_coverage", "type:s period:s n:l",
       "SELECT 'inventory' AS type, period, count(*) AS n FROM inventory GROUP BY period UNION ALL SELECT flow, period, count(*) FROM flows GROUP BY flow, period")
def _(spark, sf):
    stock = T.inventory(spark, sf).select(F.lit("inventory").alias("type"), "period")
    flows = T.flow_datasets(spark, sf, ["period"]).select(F.col("flow").alias("type"), "period")
    return stock.unionByName(flows).groupBy("type", "period").agg(F.count(F.lit(1)).alias("n"))


@query("ag25_value_histogram", "bin:l n:l", """
WITH r AS (SELECT min(Total_GIK) AS lo, max(Total_GIK) AS hi FROM inflows WHERE period = 'tune')
FINAL SELECT least(CAST(floor((Total_GIK - lo) / ((hi - lo) / 50)) AS BIGINT), 49) AS bin, count(*) AS n FROM inflows, r WHERE period = 'tune' GROUP BY 1""")
def _(spark, sf):
    v = T.inflows(spark, sf, ["Total_GIK", "period"]).where("period = 'tune'")
    edge = v.agg(F.min("Total_GIK").alias("lo"), F.max("Total_GIK").alias("hi"))
    return A.histogram(v, "Total_GIK", 50, only(edge, "lo"), only(edge, "hi"))


@query("ag25_fence_outlier_profile", "count:l mean:d std:d min:d max:d", """
WITH z AS (SELECT Total_GIK AS v FROM inflows),
g AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM z)
FINAL SELECT count(v) AS count, avg(v) AS mean, stddev(v) AS std, min(v) AS min, max(v) AS max FROM z, g
 WHERE v < a - 0.1 * (b - a) OR v > b + 0.1 * (b - a)""")
def _(spark, sf):
    # The tables hold no value beyond 1.5 spreads; a narrow fence exercises the tail.
    rows = outliers.fence_rows(T.inflows(spark, sf, ["Total_GIK"]), "Total_GIK", k=0.1)
    v = F.col("Total_GIK")
    return rows.agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
