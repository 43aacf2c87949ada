"""Two-sample tests, drift and profile comparisons (train against tune)."""

from pyspark.sql import functions as F

from stocktide.functions import pvalues as P
from stocktide.operators import drift as R
from stocktide.operators import series as S
from stocktide.operators.frames import attach, long_form
from stocktide.operators.profile import analyze, as_rows
from stocktide.sources import tables as T

from .registry import query

PAIR = ("period", "train", "tune")
_TWO = "period IN ('train', 'tune')"


def level(spark, sf):
    return T.inventory(spark, sf)


def measures(spark, sf):
    """Inflow measures as long rows (column, value)."""
    return long_form(T.inflows(spark, sf, ["period", "Quantity", "Total_GIK"]), ["period"], ["Quantity", "Total_GIK"])


_LONG = """lg AS (SELECT period, 'Quantity' AS "column", Quantity AS v FROM inflows WHERE period IN ('train', 'tune')
 UNION ALL SELECT period, 'Total_GIK', Total_GIK FROM inflows WHERE period IN ('train', 'tune'))"""
# Cumulative counts over distinct values, per column.
_CUM = """vc AS (SELECT "column", v, count(*) FILTER (period = 'train') AS n1, count(*) FILTER (period = 'tune') AS n2 FROM lg GROUP BY 1, 2),
cm AS (SELECT *, sum(n1) OVER w AS c1, sum(n2) OVER w AS c2, sum(n1) OVER p AS t1, sum(n2) OVER p AS t2, lead(v) OVER w AS nv FROM vc
 WINDOW w AS (PARTITION BY "column" ORDER BY v), p AS (PARTITION BY "column")),
rk AS (SELECT "column", max(abs(c1 / t1 - c2 / t2)) AS ks, sum(abs(c1 / t1 - c2 / t2) * coalesce(nv - v, 0)) AS wasserstein,
 sum(n1 * (c1 + c2 - n1 - n2 + (n1 + n2 + 1) / 2.0)) - max(t1) * (max(t1) + 1) / 2 AS u1, max(t1) AS n1, max(t2) AS n2 FROM cm GROUP BY 1)"""
_BINS = """ed AS (SELECT "column", min(v) AS lo, max(v) AS hi FROM lg GROUP BY 1),
bn AS (SELECT "column", least(floor((v - lo) / ((hi - lo) / 49)), 48) AS b, count(*) FILTER (period = 'train') AS a, count(*) FILTER (period = 'tune') AS c FROM lg JOIN ed USING ("column") GROUP BY 1, 2),
pq AS (SELECT "column", (a / sum(a) OVER (PARTITION BY "column") + 1e-10) / (1 + 49e-10) AS p, (c / sum(c) OVER (PARTITION BY "column") + 1e-10) / (1 + 49e-10) AS q FROM bn),
js AS (SELECT "column", sum(p * ln(p / ((p + q) / 2))) / 2 + sum(q * ln(q / ((p + q) / 2))) / 2 AS js FROM pq GROUP BY 1)"""


@query("st01_kolmogorov_smirnov", "column:s n1:l n2:l ks:d", f"WITH {_LONG}, {_CUM}\nFINAL SELECT * FROM rk", places=8)
def _(spark, sf):
    return R.rank_statistics(measures(spark, sf), "value", *PAIR, keys=["column"])


@query("st02_mann_whitney", "column:s u1:d", f"WITH {_LONG}, {_CUM}\nFINAL SELECT * FROM rk", places=2)
def _(spark, sf):
    return R.rank_statistics(measures(spark, sf), "value", *PAIR, keys=["column"])


@query("st03_wasserstein", "column:s wasserstein:d", f"WITH {_LONG}, {_CUM}\nFINAL SELECT * FROM rk")
def _(spark, sf):
    return R.rank_statistics(measures(spark, sf), "value", *PAIR, keys=["column"])


@query("st04_binned_divergence", "column:s js:d", f"WITH {_LONG}, {_BINS}\nFINAL SELECT * FROM js", places=8)
def _(spark, sf):
    return R.binned_divergence(measures(spark, sf), "value", *PAIR, keys=["column"])


def _share_sql(dims, table="inflows"):
    union = " UNION ALL ".join(f"SELECT period, '{d}' AS dimension, {d} AS label FROM {table} WHERE {_TWO}" for d in dims)
    return f"""dl AS ({union}),
dn AS (SELECT dimension, label, count(*) FILTER (period = 'train') AS n1, count(*) FILTER (period = 'tune') AS n2 FROM dl GROUP BY 1, 2),
sh AS (SELECT *, n1 / sum(n1) OVER d AS p, n2 / sum(n2) OVER d AS q, sum(CASE WHEN n1 > 0 THEN n2 END) OVER d AS seen FROM dn WINDOW d AS (PARTITION BY dimension))"""


_JSL = "sum(p * ln((p + 1e-10) / ((p + q) / 2 + 1e-10))) / 2 + sum(q * ln((q + 1e-10) / ((p + q) / 2 + 1e-10))) / 2"
_SIZE = "CASE WHEN js > 0.3 THEN 'high' WHEN js > 0.1 THEN 'medium' ELSE 'low' END AS magnitude"
_DIMS = ["Category", "Brand", "Warehouse"]


def labels(spark, sf, dims, flow="inflows"):
    df = (T.inflows if flow == "inflows" else T.outflows)(spark, sf, ["period", *dims])
    return df.unpivot(["period"], dims, "dimension", "label")


@query("st05_label_divergence", "dimension:s js:d magnitude:s", f"""WITH {_share_sql(['Partner', 'Brand'], 'outflows')},
j AS (SELECT dimension, {_JSL} AS js FROM sh GROUP BY 1)\nFINAL SELECT *, {_SIZE} FROM j""", places=8)
def _(spark, sf):
    shares = R.label_shares(labels(spark, sf, ["Partner", "Brand"], "outflows"), "label", *PAIR, keys=["dimension"])
    return R.label_divergence(shares, ["dimension"])


_DRIFT = """dr AS (SELECT dimension, sum(CASE WHEN n1 > 0 THEN (n2 - p * seen) * (n2 - p * seen) / (p * seen) ELSE 0 END) AS chi2, count(*) FILTER (n1 > 0) - 1 AS df,
 sum(CASE WHEN p > 0 THEN (q - p) * (q - p) / p ELSE 0 END) AS chi2_shares, sum(abs(p - q)) / 2 AS total_variation, count(*) FILTER (n1 = 0) AS new_labels, count(*) FILTER (n2 = 0) AS gone_labels FROM sh GROUP BY 1)"""


@query("st06_label_drift", "dimension:s chi2:d df:l total_variation:d new_labels:l gone_labels:l chi2_shares:d",
       f"WITH {_share_sql(['Partner', 'Brand', 'Warehouse'], 'outflows')}, {_DRIFT}\nFINAL SELECT * FROM dr", places=6)
def _(spark, sf):
    shares = R.label_shares(labels(spark, sf, ["Partner", "Brand", "Warehouse"], "outflows"), "label", *PAIR, keys=["dimension"])
    props = R.label_drift(shares, ["dimension"], on="shares").select("dimension", F.col("chi2").alias("chi2_shares"))
    return R.label_drift(shares, ["dimension"]).join(props, "dimension")


@query("st07_label_comparison", "dimension:s chi2:d df:l first_top:s second_top:s", f"""WITH {_share_sql(_DIMS)}, {_DRIFT},
a AS (SELECT dimension, label, row_number() OVER (PARTITION BY dimension ORDER BY n1 DESC, label) AS r FROM sh WHERE n1 > 0),
b AS (SELECT dimension, label, row_number() OVER (PARTITION BY dimension ORDER BY n2 DESC, label) AS r FROM sh WHERE n2 > 0)
FINAL SELECT dimension, chi2, df, (SELECT string_agg(label, ',' ORDER BY r) FROM a WHERE r <= 5 AND a.dimension = dr.dimension) AS first_top,
 (SELECT string_agg(label, ',' ORDER BY r) FROM b WHERE r <= 5 AND b.dimension = dr.dimension) AS second_top FROM dr""")
def _(spark, sf):
    return R.label_comparison(T.inflows(spark, sf, ["period", *_DIMS]), _DIMS, *PAIR)


@query("st08_numeric_drift", "column:s js:d ks:d wasserstein:d", f"WITH {_LONG}, {_CUM}, {_BINS}\nFINAL SELECT * FROM rk JOIN js USING (\"column\")", places=6)
def _(spark, sf):
    return R.numeric_drift(measures(spark, sf), "value", *PAIR, keys=["column"])


_LONG3 = """lg AS (SELECT period, 'quantity' AS "column", Quantity AS v FROM inflows WHERE period IN ('train', 'tune')
 UNION ALL SELECT period, 'gik', Total_GIK FROM inflows WHERE period IN ('train', 'tune')
 UNION ALL SELECT period, 'inventory', Inventory_Level FROM inventory WHERE period IN ('train', 'tune'))"""


@query("st09_drift_report", "subject:s js:d ks:d wasserstein:d u1:d chi2:d total_variation:d new_labels:l gone_labels:l", f"""
WITH {_LONG3}, {_CUM}, {_BINS}, {_share_sql(_DIMS)}, {_DRIFT}
FINAL SELECT "column" AS subject, js, ks, wasserstein, u1, NULL AS chi2, NULL AS total_variation, NULL AS new_labels, NULL AS gone_labels FROM rk JOIN js USING ("column")
UNION ALL SELECT lower(dimension), NULL, NULL, NULL, NULL, chi2, total_variation, new_labels, gone_labels FROM dr""")
def _(spark, sf):
    cols = ["period", "Quantity", "Total_GIK", *_DIMS]
    return R.drift_report(level(spark, sf), T.inflows(spark, sf, cols), *PAIR)


@query("st10_drift_by_date", "ks:d first_mean:d second_mean:d scale_change:d", """
WITH lg AS (SELECT 'x' AS "column", CASE WHEN Date < DATE '1997-01-01' THEN 'train' ELSE 'tune' END AS period, Inventory_Level AS v FROM inventory WHERE Date < DATE '1997-01-01' OR Date >= DATE '1999-01-01'),
""" + _CUM + """, mn AS (SELECT avg(v) FILTER (period = 'train') AS first_mean, avg(v) FILTER (period = 'tune') AS second_mean FROM lg)
FINAL SELECT ks, first_mean, second_mean, second_mean / first_mean AS scale_change FROM rk, mn""", places=6)
def _(spark, sf):
    tagged = R.tag_by_date(level(spark, sf), "1997-01-01", "1999-01-01")
    pair = ("sample", "first", "second")
    ranks = R.rank_statistics(tagged, "Inventory_Level", *pair).select("ks")
    means = R.scale_shift(tagged, "Inventory_Level", *pair).select("first_mean", "second_mean", F.col("mean_ratio").alias("scale_change"))
    return attach(ranks, means)


@query("st10_label_drift_by_date", "dimension:s chi2:d df:l first_top:s second_top:s", f"""
WITH tg AS (SELECT CASE WHEN Date < DATE '1997-01-01' THEN 'train' ELSE 'tune' END AS per, Category, Brand, Warehouse FROM inflows WHERE Date < DATE '1997-01-01' OR Date >= DATE '1999-01-01'),
{_share_sql(_DIMS).replace('SELECT period', 'SELECT per AS period').replace('FROM inflows', 'FROM tg').replace("WHERE period IN ('train', 'tune')", '')}, {_DRIFT},
a AS (SELECT dimension, label, row_number() OVER (PARTITION BY dimension ORDER BY n1 DESC, label) AS r FROM sh WHERE n1 > 0),
b AS (SELECT dimension, label, row_number() OVER (PARTITION BY dimension ORDER BY n2 DESC, label) AS r FROM sh WHERE n2 > 0)
FINAL SELECT dimension, chi2, df, (SELECT string_agg(label, ',' ORDER BY r) FROM a WHERE r <= 5 AND a.dimension = dr.dimension) AS first_top,
 (SELECT string_agg(label, ',' ORDER BY r) FROM b WHERE r <= 5 AND b.dimension = dr.dimension) AS second_top FROM dr""")
def _(spark, sf):
    tagged = R.tag_by_date(T.inflows(spark, sf, ["Date", *_DIMS]), "1997-01-01", "1999-01-01")
    return R.label_comparison(tagged, _DIMS, "sample", "first", "second")


def _shift_sql(src):
    st = lambda p, t: f"avg(v) FILTER (period = '{p}') AS m{t}, stddev(v) FILTER (period = '{p}') AS s{t}, quantile_cont(v, 0.5) FILTER (period = '{p}') AS d{t}, max(v) FILTER (period = '{p}') - min(v) FILTER (period = '{p}') AS r{t}"
    return f"""SELECT "column", m1 AS first_mean, m2 AS second_mean, s1 AS first_std, s2 AS second_std, m2 / m1 AS mean_ratio, s2 / s1 AS std_ratio,
 s2 * s2 / (s1 * s1) AS var_ratio, d2 / d1 AS median_ratio, r2 / r1 AS range_ratio, abs(m2 / m1 - 1) > 0.1 AS requires_adjustment FROM (SELECT "column", {st('train', 1)}, {st('tune', 2)} FROM {src} GROUP BY 1)"""


@query("st11_scale_shift", "column:s first_mean:d second_mean:d first_std:d second_std:d mean_ratio:d std_ratio:d var_ratio:d median_ratio:d range_ratio:d requires_adjustment:b",
       f"WITH {_LONG3}\nFINAL {_shift_sql('lg')}", places=6)
def _(spark, sf):
    a = level(spark, sf).select("period", F.lit("inventory").alias("column"), F.col("Inventory_Level").alias("value"))
    b = measures(spark, sf).withColumn("column", F.when(F.col("column") == "Quantity", "quantity").otherwise("gik"))
    return R.scale_shift(a.unionByName(b), "value", *PAIR, keys=["column"])


_T = """tt AS (SELECT count(*) FILTER (period = 'train') AS n1, count(*) FILTER (period = 'tune') AS n2, avg(Inventory_Level) FILTER (period = 'train') AS m1,
 avg(Inventory_Level) FILTER (period = 'tune') AS m2, variance(Inventory_Level) FILTER (period = 'train') AS v1, variance(Inventory_Level) FILTER (period = 'tune') AS v2 FROM inventory),
ts AS (SELECT *, n1 + n2 - 2 AS df, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t FROM tt)"""
_LV = """lg AS (SELECT period, 'x' AS "column", Inventory_Level AS v FROM inventory WHERE period IN ('train', 'tune'))"""


@query("st12_t_test", "n1:l n2:l mean1:d mean2:d t:d df:l", f"WITH {_T}\nFINAL SELECT n1, n2, m1 AS mean1, m2 AS mean2, t, df FROM ts", places=6)
def _(spark, sf):
    return R.t_test(level(spark, sf), "Inventory_Level", *PAIR)


@query("st13_compare_distributions", "period:s count:l mean:d median:d std:d skewness:d kurtosis:d p5:d p95:d t:d u1:d ks:d", f"""
WITH {_T}, {_LV}, {_CUM}
FINAL SELECT period, count(*) AS count, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev(v) AS std, skewness(v) AS skewness, kurtosis(v) AS kurtosis,
 quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.95) AS p95, any_value(t) AS t, any_value(u1) AS u1, any_value(ks) AS ks FROM lg, ts, rk GROUP BY period""")
def _(spark, sf):
    return R.compare_distributions(level(spark, sf), "Inventory_Level", *PAIR)


@query("st14_period_comparison", "first_avg:d second_avg:d first_std:d second_std:d percentage_change:d t:d df:l",
       f"WITH {_T}\nFINAL SELECT m1 AS first_avg, m2 AS second_avg, sqrt(v1) AS first_std, sqrt(v2) AS second_std, (m2 - m1) / m1 * 100 AS percentage_change, t, df FROM ts")
def _(spark, sf):
    return R.period_comparison(level(spark, sf), "Inventory_Level", *PAIR)


@query("st15_trend_comparison", "first_mean:d second_mean:d scale_change:d first_volatility:d second_volatility:d volatility_change:d first_slope:d second_slope:d trend_shift:s first_seasonal:b second_seasonal:b ks:d u1:d", f"""
WITH {_LV}, {_CUM}, x AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY Date) - 1 AS i FROM inventory WHERE {_TWO}),
s AS (SELECT period, avg(Inventory_Level) AS m, stddev(Inventory_Level) / avg(Inventory_Level) AS vo, regr_slope(Inventory_Level, i) AS sl FROM x GROUP BY 1),
mv AS (SELECT period, stddev(a) / avg(a) AS mv FROM (SELECT period, month(Date) AS b, avg(Inventory_Level) AS a FROM x GROUP BY 1, 2) GROUP BY 1),
wv AS (SELECT period, stddev(a) / avg(a) AS wv FROM (SELECT period, dayofweek(Date) AS b, avg(Inventory_Level) AS a FROM x GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT s.*, mv > 0.1 OR wv > 0.05 AS se, CASE WHEN sl > 0 THEN 'increasing' ELSE 'decreasing' END AS di FROM s JOIN mv USING (period) JOIN wv USING (period))
FINAL SELECT a.m AS first_mean, b.m AS second_mean, b.m / a.m AS scale_change, a.vo AS first_volatility, b.vo AS second_volatility, b.vo / a.vo AS volatility_change,
 a.sl AS first_slope, b.sl AS second_slope, CASE WHEN a.di = b.di THEN 'consistent ' || a.di ELSE a.di || ' to ' || b.di END AS trend_shift,
 a.se AS first_seasonal, b.se AS second_seasonal, ks, u1 FROM p a JOIN p b ON a.period = 'train' AND b.period = 'tune', rk""")
def _(spark, sf):
    return R.trend_comparison(level(spark, sf), *PAIR)


_B = "sh AS (SELECT Brand, count(*) FILTER (period = 'train') AS n1, count(*) FILTER (period = 'tune') AS n2 FROM flows WHERE period IN ('train', 'tune') GROUP BY 1), pq AS (SELECT Brand, n1 / sum(n1) OVER () AS p, n2 / sum(n2) OVER () AS q FROM sh)"


@query("st16_brand_preference_shift", "Brand:s p:d q:d change:d percent_change:d",
       f"WITH {_B}\nFINAL SELECT *, q - p AS change, CASE WHEN p > 0 THEN (q - p) / p * 100 END AS percent_change FROM pq", places=6)
def _(spark, sf):
    return R.preference_shift(R.label_shares(T.flow_datasets(spark, sf, ["Brand", "period"]), "Brand", *PAIR))


@query("st17_brand_value_change", "Brand:s first_avg:d second_avg:d change:d percent_change:d", """SELECT *, second_avg - first_avg AS change, (second_avg - first_avg) / nullif(first_avg, 0) * 100 AS percent_change FROM (
 SELECT Brand, coalesce(avg(Total_GIK) FILTER (period = 'train'), 0) AS first_avg, coalesce(avg(Total_GIK) FILTER (period = 'tune'), 0) AS second_avg FROM flows WHERE period IN ('train', 'tune') GROUP BY 1)""")
def _(spark, sf):
    return R.value_change(T.flow_datasets(spark, sf, ["Brand", "Total_GIK", "period"]), "Brand", "Total_GIK", *PAIR)


@query("st18_warehouse_efficiency_change", "Warehouse:s first_efficiency:d second_efficiency:d efficiency_change:d quantity_change:d value_change:d", """
WITH t AS (SELECT Warehouse, coalesce(sum(Quantity) FILTER (period = 'train'), 0) AS q1, coalesce(sum(Quantity) FILTER (period = 'tune'), 0) AS q2,
 coalesce(sum(Total_GIK) FILTER (period = 'train'), 0) AS v1, coalesce(sum(Total_GIK) FILTER (period = 'tune'), 0) AS v2 FROM flows WHERE period IN ('train', 'tune') GROUP BY 1)
FINAL SELECT Warehouse, coalesce(v1 / nullif(q1, 0), 0) AS first_efficiency, coalesce(v2 / nullif(q2, 0), 0) AS second_efficiency,
 coalesce(v2 / nullif(q2, 0), 0) - coalesce(v1 / nullif(q1, 0), 0) AS efficiency_change, q2 - q1 AS quantity_change, v2 - v1 AS value_change FROM t""")
def _(spark, sf):
    return R.efficiency_change(T.flow_datasets(spark, sf, ["Warehouse", "Quantity", "Total_GIK", "period"]), "Warehouse", *PAIR)


@query("st19_category_shift", "dimension:s label:s p:d q:d js:d magnitude:s first_quantity:d second_quantity:d", f"""
WITH {_share_sql(['Product_Type', 'Category'], 'flows')}, j AS (SELECT dimension, {_JSL} AS js FROM sh GROUP BY 1),
qt AS (SELECT Category AS label, sum(Quantity) FILTER (period = 'train') AS a, sum(Quantity) FILTER (period = 'tune') AS b FROM flows GROUP BY 1)
FINAL SELECT dimension, label, p, q, js, {_SIZE}, CASE dimension WHEN 'Category' THEN a END AS first_quantity, CASE dimension WHEN 'Category' THEN b END AS second_quantity
 FROM sh JOIN j USING (dimension) JOIN qt USING (label)""", places=6)
def _(spark, sf):
    flows = T.flow_datasets(spark, sf, ["Product_Type", "Category", "Quantity", "period"])
    dims = ["Product_Type", "Category"]
    shares = R.label_shares(flows.unpivot(["period"], dims, "dimension", "label"), "label", *PAIR, keys=["dimension"])
    out = shares.join(R.label_divergence(shares, ["dimension"]), "dimension")
    at = lambda p: F.sum(F.when(F.col("period") == p, F.col("Quantity")))
    qty = flows.groupBy(F.lit("Category").alias("dimension"), F.col("Category").alias("label")).agg(
        at("train").alias("first_quantity"), at("tune").alias("second_quantity"))
    return out.join(qty, ["dimension", "label"], "left")


@query("st20_level_profile", "Series:s mean_level:d std_level:d min_level:d max_level:d median_level:d slope:d intercept:d r2:d daily_volatility:d max_daily_change:d avg_daily_change:d month_pattern_cv:d", """
WITH x AS (SELECT *, row_number() OVER w - 1 AS i, Inventory_Level / lag(Inventory_Level) OVER w - 1 AS ch FROM stock WINDOW w AS (PARTITION BY Series ORDER BY Date)),
m AS (SELECT Series, stddev(v) / avg(v) AS cv FROM (SELECT Series, month(Date), avg(Inventory_Level) AS v FROM stock GROUP BY 1, 2) GROUP BY 1)
FINAL SELECT Series, avg(Inventory_Level) AS mean_level, stddev(Inventory_Level) AS std_level, min(Inventory_Level) AS min_level, max(Inventory_Level) AS max_level,
 quantile_cont(Inventory_Level, 0.5) AS median_level, regr_slope(Inventory_Level, i) AS slope, regr_intercept(Inventory_Level, i) AS intercept, regr_r2(Inventory_Level, i) AS r2,
 stddev(ch) AS daily_volatility, max(abs(ch)) AS max_daily_change, avg(ch) AS avg_daily_change, any_value(cv) AS month_pattern_cv FROM x JOIN m USING (Series) GROUP BY 1""")
def _(spark, sf):
    return S.level_trends(T.inventory(spark, sf, by_priority=True), ["Series"])


def _metrics(section, subject, source, *metrics):
    """Select each metric of a source as (section, subject, metric, value) rows."""
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {subject} AS subject, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM {source}" for m, e in metrics)


@query("st20_full_profile", "section:s subject:s metric:s value:d", f"""
WITH {_T}, x AS (SELECT *, row_number() OVER (ORDER BY Date) - 1 AS i, Inventory_Level / lag(Inventory_Level) OVER (ORDER BY Date) - 1 AS ch FROM inventory),
tr AS (SELECT avg(Inventory_Level) AS m, stddev(Inventory_Level) AS s, min(Inventory_Level) AS lo, max(Inventory_Level) AS hi, quantile_cont(Inventory_Level, 0.5) AS md, regr_slope(Inventory_Level, i) AS sl,
 regr_intercept(Inventory_Level, i) AS ic, regr_r2(Inventory_Level, i) AS r2, count(*) AS n, stddev(ch) AS dv, max(abs(ch)) AS mx, avg(ch) AS ac, CAST(max(Date) - min(Date) AS DOUBLE) AS span,
 (SELECT stddev(v) / avg(v) FROM (SELECT avg(Inventory_Level) AS v FROM inventory GROUP BY month(Date))) AS cv FROM x),
fl AS (SELECT sum(Quantity) FILTER (flow = 'inflows') AS qi, sum(Quantity) FILTER (flow = 'outflows') AS qo FROM flows),
tn AS (SELECT m, qo, qo * 365.0 / span / m AS t FROM tr, fl),
lb AS (SELECT flow, d, l, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY flow, d) AS sh FROM (SELECT flow, unnest(['Category', 'Brand', 'Warehouse', 'Grade']) AS d, unnest([Category, Brand, Warehouse, Grade]) AS l FROM flows) GROUP BY 1, 2, 3),
va AS (SELECT Category, avg(Total_GIK) AS m, quantile_cont(Total_GIK, 0.5) AS md, sum(Total_GIK) AS t, count(*) AS n FROM flows GROUP BY 1),
pa AS (SELECT 'month|' || month(Date) AS b, avg(Inventory_Level) AS v FROM inventory GROUP BY 1 UNION ALL SELECT 'quarter|' || quarter(Date), avg(Inventory_Level) FROM inventory GROUP BY 1
 UNION ALL SELECT 'weekday|' || dayname(Date), avg(Inventory_Level) FROM inventory GROUP BY 1 UNION ALL SELECT 'year|' || year(Date), avg(Inventory_Level) FROM inventory GROUP BY 1),
pf AS (SELECT dim, lab, coalesce(sum(Quantity) FILTER (flow = 'inflows'), 0) AS a, avg(Quantity) FILTER (flow = 'inflows') AS b, count(*) FILTER (flow = 'inflows') AS c, coalesce(sum(Total_GIK) FILTER (flow = 'inflows'), 0) AS d,
 coalesce(sum(Quantity) FILTER (flow = 'outflows'), 0) AS e, avg(Quantity) FILTER (flow = 'outflows') AS f, count(*) FILTER (flow = 'outflows') AS g, coalesce(sum(Total_GIK) FILTER (flow = 'outflows'), 0) AS h
 FROM (SELECT *, unnest(['categories', 'warehouses']) AS dim, unnest([Category, Warehouse]) AS lab FROM flows) GROUP BY 1, 2)
FINAL {_metrics('trends', "'all'", 'tr', ('mean_level', 'm'), ('std_level', 's'), ('min_level', 'lo'), ('max_level', 'hi'), ('median_level', 'md'), ('slope', 'sl'), ('intercept', 'ic'), ('r2', 'r2'), ('n', 'n'),
 ('daily_volatility', 'dv'), ('max_daily_change', 'mx'), ('avg_daily_change', 'ac'), ('month_pattern_cv', 'cv'))}
UNION ALL {_metrics('turnover', "'all'", 'tn', ('avg_inventory', 'm'), ('total_outflows', 'qo'), ('turnover', 't'), ('days_of_stock', '365.0 / t'))}
UNION ALL {_metrics('balance', "'all'", 'fl', ('total_inflows', 'qi'), ('total_outflows', 'qo'), ('net_change', 'qi - qo'), ('flow_ratio', 'qi / qo'))}
UNION ALL {_metrics('labels', "flow || '|' || d || '|' || l", 'lb', ('n', 'n'), ('share', 'sh'))}
UNION ALL {_metrics('values', 'Category', 'va', ('mean', 'm'), ('median', 'md'), ('total', 't'), ('n', 'n'))}
UNION ALL {_metrics('patterns', 'b', 'pa', ('mean_level', 'v'))}
UNION ALL {_metrics('', 'lab', 'pf', ('in_sum', 'a'), ('in_mean', 'b'), ('in_count', 'c'), ('in_value', 'd'), ('out_sum', 'e'), ('out_mean', 'f'), ('out_count', 'g'), ('out_value', 'h'), ('net_flow', 'a - e')).replace("'' AS section", 'dim AS section')}
UNION ALL {_metrics('change', "'all'", 'ts', ('first_avg', 'm1'), ('second_avg', 'm2'), ('first_std', 'sqrt(v1)'), ('second_std', 'sqrt(v2)'), ('percentage_change', '(m2 - m1) / m1 * 100'), ('t', 't'), ('df', 'df'))}
UNION ALL {_metrics('key_metrics', "'all'", 'tr, tn', ('avg_inventory', 'tr.m'), ('peak_inventory', 'hi'), ('min_inventory', 'lo'), ('inventory_volatility', 'dv'), ('turnover_rate', 't'), ('days_of_stock', '365.0 / t'))}""")
def _(spark, sf):
    flows = T.flow_datasets(spark, sf, ["Category", "Brand", "Warehouse", "Grade", "Quantity", "Total_GIK"])
    return as_rows(analyze(level(spark, sf), flows))


# Tail probabilities are not SQL; these run without an oracle.
@query("st_rank_test_pvalues", "column:s ks:d ks_p:d u1:d mw_p:d drift:b", places=8)
def _(spark, sf):
    out = R.with_rank_p(R.rank_statistics(measures(spark, sf), "value", *PAIR, keys=["column"]))
    return out.withColumn("drift", (F.col("ks_p") < 0.05) | (F.col("mw_p") < 0.05))


@query("st_label_test_pvalues", "dimension:s chi2:d p_value:d drift:b", places=8)
def _(spark, sf):
    shares = R.label_shares(labels(spark, sf, _DIMS), "label", *PAIR, keys=["dimension"])
    out = R.label_drift(shares, ["dimension"])
    out = out.withColumn("p_value", P.chi2_p("chi2", F.col("df").cast("double")))
    return out.withColumn("drift", F.col("p_value") < 0.05)


@query("st_mean_test_pvalues", "t:d df:d p_value:d significant:b", places=8)
def _(spark, sf):
    out = R.t_test(level(spark, sf), "Inventory_Level", *PAIR)
    out = out.withColumn("p_value", P.t_p("t", "df"))
    return out.withColumn("significant", F.col("p_value") < 0.05)


@query("st_trend_pvalues", "Series:s slope:d r2:d p_value:d", places=8)
def _(spark, sf):
    fit = S.linear_trend(T.inventory(spark, sf, by_priority=True), ["Series"], "Date", "Inventory_Level")
    return fit.withColumn("p_value", P.slope_p(F.col("r2"), F.col("n")))
