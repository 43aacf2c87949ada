"""Stock policy, risks, alerts and policy projections."""

from pyspark.sql import functions as F

from stocktide.operators import alerts as L
from stocktide.operators import evaluate as E
from stocktide.operators import outliers as O
from stocktide.operators import policy as P
from stocktide.operators.frames import rows_of
from stocktide.session import materialize
from stocktide.sources import tables as T

from .aggregate_queries import label_sql
from .forecast_queries import FORECAST_SQL, K, simple_forecasts, tune_levels
from .outlier_queries import _DS, measured
from .registry import query
from .statistics_queries import _BINS, _LONG3

_W = f"WITH {FORECAST_SQL}"
_COLS = ["Date", "Quantity", "Category", "Warehouse", "period"]


def scored(spark, sf):
    return E.accuracy(tune_levels(spark, sf), simple_forecasts(spark, sf), K)


_IN1 = """in1 AS (SELECT Category, avg(Quantity) AS m, stddev(Quantity) AS s FROM outflows WHERE period = 'tune' GROUP BY 1)"""


@query("in01_reorder_by_category", "Category:s avg_daily_demand:d demand_std:d reorder_point:d",
       f"WITH {_IN1}\nFINAL SELECT Category, round_even(m, 2) AS avg_daily_demand, round_even(s, 2) AS demand_std, round_even(7 * m + 1.5 * s, 0) AS reorder_point FROM in1")
def _(spark, sf):
    return P.reorder_by_category(T.outflows(spark, sf, _COLS).where("period = 'tune'"))


def _cells(src="outflows"):
    return f"""dy AS (SELECT Category, Warehouse, Date, sum(Quantity) AS q FROM {src} GROUP BY 1, 2, 3),
ce AS (SELECT Category, Warehouse, sum(q) AS t, avg(q) AS m, stddev(q) AS s, count(*) AS n, max(Date) - min(Date) AS span FROM dy GROUP BY 1, 2),
cu AS (SELECT arg_max(Inventory_Level, Date) AS cl, avg(Inventory_Level) AS al FROM inventory),
ro AS (SELECT Category, Warehouse, cl, t / span AS d, CASE WHEN n > 1 THEN s ELSE t / span * 0.1 END AS v FROM ce, cu WHERE span > 0)"""


@query("in02_reorder_by_cell", "Category:s Warehouse:s current_level:d reorder_point:d avg_daily_demand:d lead_time_days:l variability:d status:s", f"""WITH {_cells()}
FINAL SELECT Category, Warehouse, cl AS current_level, round_even(7 * d + 1.5 * v, 0) AS reorder_point, round_even(d, 2) AS avg_daily_demand, 7 AS lead_time_days,
 round_even(v, 2) AS variability, CASE WHEN cl < 7 * d + 1.5 * v THEN 'REORDER_NEEDED' ELSE 'OK' END AS status FROM ro""")
def _(spark, sf):
    return P.reorder_by_cell(T.outflows(spark, sf, _COLS), T.inventory(spark, sf))


_SS = """ss AS (SELECT Series, model, lv AS service_level, round_even(z * mae, 0) AS safety_stock FROM mt, (VALUES ('95.0%', 1.65), ('98.0%', 2.05), ('99.0%', 2.33)) AS v(lv, z))"""


@query("in03_safety_by_model", "Series:s model:s service_level:s safety_stock:d", f"{_W}, {_SS}\nFINAL SELECT * FROM ss")
def _(spark, sf):
    return P.safety_by_model(scored(spark, sf), K)


@query("in04_safety_by_cell", "Category:s Warehouse:s safety_stock:d avg_daily_demand:d demand_std:d", f"""WITH {_cells()}
FINAL SELECT Category, Warehouse, round_even(1.96 * s * sqrt(7), 0) AS safety_stock, round_even(m, 2) AS avg_daily_demand, round_even(s, 2) AS demand_std FROM ce WHERE n > 1""")
def _(spark, sf):
    return P.safety_by_cell(T.outflows(spark, sf, _COLS))


@query("in05_optimisation", "section:s subject:s value:d", f"""{_W}, {_SS}, {_IN1},
tn AS (SELECT (SELECT sum(Quantity) FROM outflows WHERE period = 'tune') * 365.0 / count(*) / avg(Inventory_Level) AS t FROM inventory WHERE period = 'tune')
FINAL SELECT 'reorder_point' AS section, Category AS subject, round_even(7 * m + 1.5 * s, 0) AS value FROM in1
UNION ALL SELECT 'safety_stock', Series || '|' || model || '|' || service_level, safety_stock FROM ss
UNION ALL SELECT 'turnover', {label_sql('t')}, t FROM tn""", places=6)
def _(spark, sf):
    tune = "period = 'tune'"
    return P.optimisation(T.outflows(spark, sf, _COLS).where(tune), T.inventory(spark, sf).where(tune), scored(spark, sf), K)


def _trend(limit, src="inflows"):
    return f"""md AS (SELECT quantile_cont(CAST(Date - DATE '1970-01-01' AS DOUBLE), 0.5) AS mid FROM {src}),
ct AS (SELECT Category, sum(Quantity) FILTER (Date - DATE '1970-01-01' <= mid) AS early, sum(Quantity) FILTER (Date - DATE '1970-01-01' > mid) AS late FROM {src}, md GROUP BY 1),
gr AS (SELECT *, (late - early) / early * 100 AS growth FROM ct WHERE early > 0 AND late IS NOT NULL),
kd AS (SELECT *, CASE WHEN growth > {limit} THEN 'growing' ELSE 'declining' END AS kind FROM gr WHERE abs(growth) > {limit}),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs(growth) DESC, Category) AS r FROM kd) WHERE r <= 5)"""


@query("in06_category_trends", "kind:s Category:s early:d late:d growth:d", f"WITH {_trend(0.5)}\nFINAL SELECT * FROM tk")
def _(spark, sf):
    # Categories grow evenly here; half a percent separates them.
    return P.category_trends(T.inflows(spark, sf, ["Date", "Category", "Quantity"]), limit=0.5)


def _eff(src="flows"):
    return f"""ef AS (SELECT Warehouse, coalesce(sum(Quantity) FILTER (flow = 'inflows'), 0) AS i, coalesce(sum(Quantity) FILTER (flow = 'outflows'), 0) AS o,
 coalesce(avg(Quantity) FILTER (flow = 'inflows'), 0) AS ai, coalesce(avg(Quantity) FILTER (flow = 'outflows'), 0) AS ao FROM {src} GROUP BY 1),
eg AS (SELECT *, CASE WHEN i > 0 THEN o / i ELSE 0 END AS th, least(CASE WHEN i > 0 THEN o / i ELSE 0 END, 1) * 100 AS sc FROM ef)"""


@query("in07_warehouse_efficiency", "Warehouse:s total_inflows:d total_outflows:d throughput:d score:d avg_inflow:d avg_outflow:d status:s", f"""WITH {_eff()}
FINAL SELECT Warehouse, i AS total_inflows, o AS total_outflows, th AS throughput, sc AS score, round_even(ai, 0) AS avg_inflow, round_even(ao, 0) AS avg_outflow,
 CASE WHEN sc > 80 THEN 'High' WHEN sc > 60 THEN 'Medium' ELSE 'Low' END AS status FROM eg""")
def _(spark, sf):
    return P.warehouse_efficiency(T.flow_datasets(spark, sf, ["Warehouse", "Quantity"]))


def _opp(src="outflows"):
    return f"""oc AS (SELECT Category, sum(Quantity) AS t, stddev(Quantity) AS s FROM {src} GROUP BY 1),
o1 AS (SELECT 'SLOW_MOVING_INVENTORY' AS type, Category AS category, t AS value, 'Medium' AS priority FROM oc ORDER BY t, Category LIMIT 3),
o2 AS (SELECT 'HIGH_DEMAND_VARIABILITY' AS type, Category AS category, s AS value, 'High' AS priority FROM oc ORDER BY s DESC, Category LIMIT 2),
o3 AS (SELECT 'EXCESS_INVENTORY' AS type, 'Overall' AS category, cl AS value, 'Medium' AS priority FROM (SELECT arg_max(Inventory_Level, Date) AS cl, avg(Inventory_Level) AS al FROM inventory) WHERE cl > al * 1.5),
op AS (SELECT * FROM o1 UNION ALL SELECT * FROM o2 UNION ALL SELECT * FROM o3)"""


@query("in08_opportunities", "type:s category:s value:d priority:s", f"WITH {_opp()}\nFINAL SELECT * FROM op")
def _(spark, sf):
    return P.opportunities(T.outflows(spark, sf, ["Category", "Quantity"]), T.inventory(spark, sf))


def _risk(src="flows", forecasts=True):
    low = "UNION ALL SELECT 'FORECAST_LOW_INVENTORY', 'HIGH', fl, cl, fl < cl * 0.3 FROM lv, (SELECT min(yhat) AS fl FROM fc)" if forecasts else ""
    return f"""lv AS (SELECT arg_max(Inventory_Level, Date) AS cl, avg(Inventory_Level) AS al FROM inventory),
fe AS (SELECT flow, max(Date) - 30 AS f FROM {src} GROUP BY 1),
rb AS (SELECT flow, avg(Quantity) FILTER (Date >= f) AS rc, avg(Quantity) FILTER (Date < f) AS bf FROM {src} JOIN fe USING (flow) GROUP BY 1),
rr AS (SELECT 'LOW_INVENTORY' AS type, 'HIGH' AS severity, cl AS value, al AS reference, cl < al * 0.5 AS fired FROM lv
 UNION ALL SELECT 'DECLINING_INFLOWS', 'MEDIUM', rc, bf, rc < bf * 0.7 FROM rb WHERE flow = 'inflows'
 UNION ALL SELECT 'INCREASING_DEMAND', 'MEDIUM', rc, bf, rc > bf * 1.3 FROM rb WHERE flow = 'outflows' {low}),
rk AS (SELECT * FROM rr WHERE fired)"""


@query("in09_level_and_flow_risks", "type:s severity:s value:d reference:d", f"{_W}, {_risk('flows')}\nFINAL SELECT * FROM rk")
def _(spark, sf):
    return L.level_and_flow_risks(T.inventory(spark, sf), T.flow_datasets(spark, sf, ["Date", "Quantity"]), simple_forecasts(spark, sf))


@query("in10_operational_risks", "type:s severity:s value:d reference:d", f"""{_W}, {_LONG3}, {_BINS}, {_DS},
cv AS (SELECT stddev(Inventory_Level) / avg(Inventory_Level) AS cv FROM inventory WHERE period = 'tune'),
ds2 AS (SELECT CASE WHEN max(js) > 0.5 THEN 'high' WHEN max(js) > 0.2 THEN 'medium' END AS s FROM js),
gw AS (SELECT avg(Inventory_Level) FILTER (d <= 30) / avg(Inventory_Level) FILTER (a <= 30) - 1 AS g FROM (SELECT *, row_number() OVER (ORDER BY Date) AS a, row_number() OVER (ORDER BY Date DESC) AS d FROM inventory WHERE period = 'tune'))
FINAL SELECT 'EXTREME_VALUES' AS type, 'high' AS severity, n AS value, 1e6 AS reference FROM (SELECT count(*) AS n FROM dr WHERE "column" = 'Total_GIK' AND value > 1e6) WHERE n > 0
UNION ALL SELECT 'DATA_DRIFT', s, 0, 0 FROM ds2 WHERE s IS NOT NULL UNION ALL SELECT 'INVENTORY_VOLATILITY', 'medium', cv, 0.3 FROM cv WHERE cv > 0.3
UNION ALL SELECT 'CAPACITY', 'medium', g * 100, 50 FROM gw WHERE g > 0.5 UNION ALL SELECT 'FORECAST_UNCERTAINTY', 'medium', m, 30 FROM (SELECT max(mape) AS m FROM mt) WHERE m > 30""")
def _(spark, sf):
    return operational_risks(spark, sf, trees=False)


def operational_risks(spark, sf, trees):
    found = O.detect(*measured(spark, sf), trees=trees)
    level = materialize(T.inventory(spark, sf).where("period = 'tune'"), "levels")
    return L.operational_risks(found["outliers"], found["summary"], level, scored(spark, sf))


@query("in10_operational_risks_three_methods", "type:s severity:s value:d reference:d")
def _(spark, sf):
    return operational_risks(spark, sf, trees=True)


@query("in11_recommendations", "title:s priority:s impact:s", f"""WITH {_DS}, {_LONG3},
sr AS (SELECT greatest(abs(1 - avg(v) FILTER (period = 'tune') / avg(v) FILTER (period = 'train')), CASE WHEN "column" = 'inventory' THEN abs(1 - stddev(v) FILTER (period = 'tune') / stddev(v) FILTER (period = 'train')) ELSE 0 END) AS r FROM lg WHERE "column" <> 'gik' GROUP BY "column")
FINAL SELECT 'Improve Data Quality and Governance' AS title, 'High' AS priority, 'High' AS impact FROM (SELECT count(*) AS n FROM dr) WHERE n > 50
UNION ALL SELECT 'Adapt Inventory Management for Scale Changes', 'High', 'High' FROM (SELECT max(r) AS r FROM sr) WHERE r > 0.3
UNION ALL SELECT 'Diversify Product Category Portfolio', 'Medium', 'Medium' FROM (SELECT max(n) * 100.0 / sum(n) AS s FROM (SELECT count(*) AS n FROM inflows WHERE period = 'tune' GROUP BY Category)) WHERE s > 60
UNION ALL SELECT 'Implement Seasonal Inventory Planning', 'Medium', 'High'""")
def _(spark, sf):
    return recommendations(spark, sf, trees=False)


@query("in11_recommendations_three_methods", "title:s priority:s impact:s")
def _(spark, sf):
    return recommendations(spark, sf, trees=True)


def recommendations(spark, sf, trees):
    stock, flows = measured(spark, sf, dims=())
    models = simple_forecasts(spark, sf).select("model").distinct()
    return L.recommendations(O.flagged_datasets(stock, flows, trees=trees), O.period_shifts(stock, flows), models, T.inflows(spark, sf, ["Category", "period"]).where("period = 'tune'"))


def _run_sql(flows, outflows, inflows, tail=""):
    return f"""{_cells(outflows)}, {_trend(20, inflows)}, {_eff(flows)}, {_opp(outflows)}, {_risk(flows)},
di AS (SELECT *, row_number() OVER (PARTITION BY Category ORDER BY Date) - 1 AS i FROM (SELECT Category, Date, sum(Quantity) AS q FROM {outflows} GROUP BY 1, 2)),
dm AS (SELECT Category, greatest(0, round_even(avg(q) + 30 * regr_slope(q, i), 2)) AS f FROM di GROUP BY 1 HAVING count(*) > 1),
run AS (SELECT 'reorder_point' AS section, Category || '|' || Warehouse AS subject, round_even(7 * d + 1.5 * v, 0) AS value FROM ro
UNION ALL SELECT 'safety_stock', Category || '|' || Warehouse, round_even(1.96 * s * sqrt(7), 0) FROM ce WHERE n > 1
UNION ALL SELECT 'risk', type, value FROM rk UNION ALL SELECT 'category_trend', kind || '|' || Category, growth FROM tk
UNION ALL SELECT 'warehouse_score', Warehouse, sc FROM eg UNION ALL SELECT 'demand', Category, f FROM dm
UNION ALL SELECT 'opportunity', type || '|' || category, value FROM op {tail})"""


@query("in12_insight_run", "section:s subject:s value:d", f"""{_W}, {_SS}, {_run_sql('flows', 'outflows', 'inflows', "UNION ALL SELECT 'model_safety_stock', Series || '|' || model || '|' || service_level, safety_stock FROM ss")}
FINAL SELECT * FROM run""")
def _(spark, sf):
    flows = T.flow_datasets(spark, sf, ["Date", "Quantity", "Category", "Warehouse"])
    forecasts = materialize(simple_forecasts(spark, sf), "forecasts")
    stock = materialize(T.inventory(spark, sf), "levels")
    return L.insight_run(stock, flows, forecasts, E.accuracy(tune_levels(spark, sf), forecasts, K), K)


@query("in18_filtered_insights", "section:s subject:s value:d", f"""{_W}, fflows AS (SELECT * FROM flows WHERE Warehouse IN ('NATION_1', 'NATION_3', 'NATION_7') AND Category IN ('PROMO', 'SMALL', 'LARGE')),
fout AS (SELECT * FROM fflows WHERE flow = 'outflows'), fin AS (SELECT * FROM fflows WHERE flow = 'inflows'), {_run_sql('fflows', 'fout', 'fin')}
FINAL SELECT * FROM run""")
def _(spark, sf):
    flows = T.flow_datasets(spark, sf, ["Date", "Quantity", "Category", "Warehouse"])
    return L.filtered_insights(materialize(T.inventory(spark, sf), "levels"), flows, ["NATION_1", "NATION_3", "NATION_7"], ["PROMO", "SMALL", "LARGE"], forecasts=simple_forecasts(spark, sf))


def _live_sql(out, inn):
    cat = "\n ".join(f"UNION ALL SELECT 'category', Category || '|{m}', {m} FROM lg2" for m in (
        "tune_value", "tune_volume", "train_value", "train_volume", "tune_avg", "train_avg", "volume_growth", "value_growth"))
    per = "\n ".join(f"UNION ALL SELECT 'performance', '{m}', {m} FROM lpf" for m in (
        "average_level", "peak_level", "minimum_level", "variation", "total_volume", "average_size", "donations"))
    return f"""{_W}, {_SS}, {_LONG3}, {_BINS}, {_DS},
lsr AS (SELECT greatest(abs(1 - avg(v) FILTER (period = 'tune') / avg(v) FILTER (period = 'train')), CASE WHEN "column" = 'inventory' THEN abs(1 - stddev(v) FILTER (period = 'tune') / stddev(v) FILTER (period = 'train')) ELSE 0 END) AS r FROM lg WHERE "column" <> 'gik' GROUP BY "column"),
lcv AS (SELECT stddev(Inventory_Level) / avg(Inventory_Level) AS cv FROM inventory WHERE period = 'tune'),
lse AS (SELECT CASE WHEN max(js) > 0.5 THEN 'high' WHEN max(js) > 0.2 THEN 'medium' END AS s FROM js),
lgw AS (SELECT avg(Inventory_Level) FILTER (d <= 30) / avg(Inventory_Level) FILTER (a <= 30) - 1 AS g FROM (SELECT *, row_number() OVER (ORDER BY Date) AS a, row_number() OVER (ORDER BY Date DESC) AS d FROM inventory WHERE period = 'tune')),
lro AS (SELECT Category, avg(Quantity) AS m, stddev(Quantity) AS s FROM {out} WHERE period = 'tune' GROUP BY 1),
ltn AS (SELECT (SELECT sum(Quantity) FROM {out} WHERE period = 'tune') * 365.0 / count(*) / avg(Inventory_Level) AS t FROM inventory WHERE period = 'tune'),
lct AS (SELECT Category, sum(Total_GIK) FILTER (period = 'tune') AS tune_value, avg(Total_GIK) FILTER (period = 'tune') AS tune_avg, count(*) FILTER (period = 'tune') AS tune_volume,
 sum(Total_GIK) FILTER (period = 'train') AS train_value, avg(Total_GIK) FILTER (period = 'train') AS train_avg, count(*) FILTER (period = 'train') AS train_volume FROM {inn} WHERE period IN ('tune', 'train') GROUP BY 1),
lg2 AS (SELECT *, (tune_volume - train_volume) * 100.0 / nullif(train_volume, 0) AS volume_growth, (tune_avg - train_avg) * 100.0 / train_avg AS value_growth FROM lct),
lbr AS (SELECT Category, Brand, count(*) AS n, row_number() OVER (PARTITION BY Category ORDER BY count(*) DESC, Brand) AS r FROM {inn} WHERE period = 'tune' GROUP BY 1, 2),
lpf AS (SELECT * FROM (SELECT avg(Inventory_Level) AS average_level, max(Inventory_Level) AS peak_level, min(Inventory_Level) AS minimum_level, stddev(Inventory_Level) / avg(Inventory_Level) AS variation FROM inventory WHERE period = 'tune'),
 (SELECT sum(Quantity) AS total_volume, avg(Quantity) AS average_size, count(*) AS donations FROM {inn} WHERE period = 'tune')),
live AS (SELECT 'recommendation' AS section, 'High|Improve Data Quality and Governance' AS subject, CAST(1 AS DOUBLE) AS value FROM (SELECT count(*) AS n FROM dr) WHERE n > 50
 UNION ALL SELECT 'recommendation', 'High|Adapt Inventory Management for Scale Changes', 1 FROM (SELECT max(r) AS r FROM lsr) WHERE r > 0.3
 UNION ALL SELECT 'recommendation', 'Medium|Diversify Product Category Portfolio', 1 FROM (SELECT max(n) * 100.0 / sum(n) AS s FROM (SELECT count(*) AS n FROM {inn} WHERE period = 'tune' GROUP BY Category)) WHERE s > 60
 UNION ALL SELECT 'recommendation', 'Medium|Implement Seasonal Inventory Planning', 1
 UNION ALL SELECT 'risk_alert', 'high|EXTREME_VALUES', n FROM (SELECT count(*) AS n FROM dr WHERE "column" = 'Total_GIK' AND value > 1e6) WHERE n > 0
 UNION ALL SELECT 'risk_alert', s || '|DATA_DRIFT', 0 FROM lse WHERE s IS NOT NULL UNION ALL SELECT 'risk_alert', 'medium|INVENTORY_VOLATILITY', cv FROM lcv WHERE cv > 0.3
 UNION ALL SELECT 'risk_alert', 'medium|CAPACITY', g * 100 FROM lgw WHERE g > 0.5 UNION ALL SELECT 'risk_alert', 'medium|FORECAST_UNCERTAINTY', m FROM (SELECT max(mape) AS m FROM mt) WHERE m > 30
 UNION ALL SELECT 'reorder_point', Category, round_even(7 * m + 1.5 * s, 0) FROM lro UNION ALL SELECT 'safety_stock', Series || '|' || model || '|' || service_level, safety_stock FROM ss
 UNION ALL SELECT 'turnover', {label_sql('t')}, t FROM ltn
 {cat}
 UNION ALL SELECT 'category_brand', Category || '|' || Brand, n FROM lbr WHERE r <= 3
 {per})"""


def live(spark, sf, **choice):
    stock, flows = materialize(T.inventory(spark, sf), "levels"), T.flow_datasets(spark, sf, ["period", "Row_Id", "Date", "Quantity", "Total_GIK", "Category", "Brand", "Warehouse"])
    forecasts = materialize(simple_forecasts(spark, sf), "forecasts")
    found = O.detect(stock, flows, trees=False)
    return L.live_run(stock, flows, found, forecasts.select("model").distinct(), E.accuracy(tune_levels(spark, sf), forecasts, K), K, **choice)


@query("in12_live_run", "section:s subject:s value:d", f"""{_live_sql('outflows', 'inflows')}
FINAL SELECT * FROM live WHERE value IS NOT NULL""", places=3)
def _(spark, sf):
    return live(spark, sf)


@query("in18_filtered_live_run", "section:s subject:s value:d", _live_sql("lfo", "lfi").replace("WITH ", """WITH lff AS (SELECT * FROM flows WHERE Warehouse IN ('NATION_1', 'NATION_3', 'NATION_7') AND Category IN ('PROMO', 'SMALL', 'LARGE')),
lfo AS (SELECT * FROM lff WHERE flow = 'outflows'), lfi AS (SELECT * FROM lff WHERE flow = 'inflows'), """, 1) + "\nFINAL SELECT * FROM live WHERE value IS NOT NULL", places=3)
def _(spark, sf):
    return live(spark, sf, warehouses=["NATION_1", "NATION_3", "NATION_7"], categories=["PROMO", "SMALL", "LARGE"])


# Narrow bands, so that the flat forecasts of these tables raise alerts.
_BANDS = {"low": 1.0, "critical": 0.85, "high": 1.05}
_ALERT = f"""bl AS (SELECT Series, avg(Inventory_Level) AS av FROM stock WHERE period IN ('train', 'tune') GROUP BY 1),
ar AS (SELECT Series, model, ds, yhat, av, ds - DATE '1998-01-01' AS du, CASE WHEN yhat < av * {_BANDS['critical']} THEN 'critical' WHEN yhat < av * {_BANDS['low']} THEN 'stockout' WHEN yhat > av * {_BANDS['high']} THEN 'overstock' END AS kind FROM fc JOIN bl USING (Series)),
al AS (SELECT Series, model, ds AS date, round_even(yhat, 0) AS predicted_level, round_even(CASE kind WHEN 'overstock' THEN av * {_BANDS['high']} ELSE av * {_BANDS['low']} END, 0) AS threshold,
 CASE kind WHEN 'critical' THEN 'critical' ELSE 'warning' END AS severity, du AS days_until, kind FROM ar WHERE kind IS NOT NULL AND du BETWEEN 0 AND 14),
ac AS (SELECT count(*) FILTER (kind = 'stockout') AS s, count(*) FILTER (kind = 'critical') AS c, count(*) FILTER (kind = 'overstock') AS o FROM al)"""


def alerts(spark, sf):
    stock = T.inventory(spark, sf, by_priority=True).where("period in ('train', 'tune')")
    base = stock.groupBy(*K).agg(F.avg("Inventory_Level").alias("average"))
    return L.forecast_alerts(simple_forecasts(spark, sf), base, "1998-01-01", K, **_BANDS)


@query("in13_forecast_alerts", "Series:s model:s date:s predicted_level:d threshold:d severity:s days_until:l kind:s", f"{_W}, {_ALERT}\nFINAL SELECT * FROM al")
def _(spark, sf):
    return alerts(spark, sf)


@query("in14_alert_summary", "stockout_alerts:l critical_alerts:l overstock_alerts:l", f"{_W}, {_ALERT}\nFINAL SELECT s AS stockout_alerts, c AS critical_alerts, o AS overstock_alerts FROM ac")
def _(spark, sf):
    return L.alert_summary(alerts(spark, sf))


@query("in14_alert_advice", "advice:s", f"""{_W}, {_ALERT}, ad AS (SELECT 'expedite_procurement' AS advice FROM ac WHERE c > 0 UNION ALL SELECT 'raise_safety_stock' FROM ac WHERE s > 3
 UNION ALL SELECT 'reduce_excess' FROM ac WHERE o > 3 UNION ALL SELECT 'dynamic_reorder_policy' FROM ac WHERE s > 0 AND o > 0)
FINAL SELECT * FROM ad UNION ALL SELECT 'stable' WHERE NOT EXISTS (SELECT * FROM ad)""")
def _(spark, sf):
    return L.alert_advice(L.alert_summary(alerts(spark, sf)))


_SCENARIOS = [("lean", 20000.0, 10000.0, 7, 30000.0, None), ("safe", 100000.0, 60000.0, 7, 80000.0, None), ("slow", 50000.0, 50000.0, 21, 40000.0, 90000.0)]
_SC = """sn AS (SELECT * FROM (VALUES ('lean', 20000.0::DOUBLE, 10000.0::DOUBLE, 7, 30000.0::DOUBLE, NULL::DOUBLE), ('safe', 100000.0, 60000.0, 7, 80000.0, NULL), ('slow', 50000.0, 50000.0, 21, 40000.0, 90000.0)) AS v(scenario, rp, ss, lt, oq, ini)),
tr AS (SELECT Series, ds, yhat, row_number() OVER (PARTITION BY Series ORDER BY ds) AS n FROM fc WHERE model = 'Trend'),
pj AS (SELECT Series, scenario, 0 AS n, NULL::DATE AS ds, coalesce(ini, yhat) AS lv, NULL::DATE AS due, 0.0::DOUBLE AS fdem, false AS so, rp, ss, lt, oq FROM tr, sn WHERE n = 1
 UNION ALL SELECT Series, scenario, n, ds, l2, CASE WHEN l2 < ss AND d2 IS NULL THEN ds + lt ELSE d2 END, fdem, l2 < ss, rp, ss, lt, oq FROM (
 SELECT *, greatest(0, l1 - 0.01 * fdem) AS l2, CASE WHEN l1 <= rp AND d1 IS NULL THEN ds + lt ELSE d1 END AS d2 FROM (
 SELECT pj.Series, scenario, t.n, t.ds, abs(t.yhat) AS fdem, CASE WHEN due <= t.ds THEN lv + oq ELSE lv END AS l1, CASE WHEN due <= t.ds THEN NULL ELSE due END AS d1, rp, ss, lt, oq
 FROM pj JOIN tr t ON t.Series = pj.Series AND t.n = pj.n + 1))),
pr2 AS (SELECT Series, scenario, ds, lv AS inventory_level, fdem AS forecast_demand, due IS NOT NULL AS pending, so AS stockout FROM pj WHERE n > 0),
pn AS (SELECT *, pending AND NOT coalesce(lag(pending) OVER (PARTITION BY Series, scenario ORDER BY ds), false) AS nw FROM pr2),
sm AS (SELECT Series, scenario, count(*) FILTER (stockout) AS stockout_days, avg(inventory_level) AS avg_inventory, min(inventory_level) AS min_inventory, max(inventory_level) AS max_inventory,
 count(*) FILTER (pending) AS pending_days, count(*) FILTER (nw) AS pending_spells, (count(*) - count(*) FILTER (stockout)) * 100.0 / count(*) AS service_level FROM pn GROUP BY 1, 2)"""


def projection(spark, sf):
    scenarios = rows_of(spark, _SCENARIOS, P.SCENARIO)
    return P.project(simple_forecasts(spark, sf).where("model = 'Trend'"), scenarios, K)


@query("in15_policy_projection", "Series:s scenario:s ds:s inventory_level:d forecast_demand:d pending:b stockout:b", f"{_W}, {_SC}\nFINAL SELECT * FROM pr2", places=3)
def _(spark, sf):
    return projection(spark, sf)


_SM_OUT = "Series:s scenario:s stockout_days:l avg_inventory:d min_inventory:d max_inventory:d pending_days:l pending_spells:l service_level:d"


@query("in16_scenario_metrics", _SM_OUT, f"{_W}, {_SC}\nFINAL SELECT * FROM sm", places=3)
def _(spark, sf):
    return P.scenario_metrics(projection(spark, sf), K)


@query("in17_scenario_comparison", _SM_OUT + " risk_level:s best_service:b best_inventory:b best_overall:b", f"""{_W}, {_SC}
FINAL SELECT *, CASE WHEN stockout_days > 10 THEN 'High' WHEN stockout_days > 5 THEN 'Medium' ELSE 'Low' END AS risk_level,
 row_number() OVER (PARTITION BY Series ORDER BY service_level DESC, scenario) = 1 AS best_service, row_number() OVER (PARTITION BY Series ORDER BY avg_inventory, scenario) = 1 AS best_inventory,
 row_number() OVER (PARTITION BY Series ORDER BY service_level * 0.6 + (100 - stockout_days) * 0.4 DESC, scenario) = 1 AS best_overall FROM sm""", places=3)
def _(spark, sf):
    return P.compare_scenarios(P.scenario_metrics(projection(spark, sf), K), K)


_COVER = """cd AS (SELECT Series, ds, 0.01 * abs(yhat) AS d, sum(0.01 * abs(yhat)) OVER w AS c, first_value(yhat) OVER w AS f FROM fc WHERE model = 'Trend' WINDOW w AS (PARTITION BY Series ORDER BY ds)),
cl AS (SELECT *, coalesce(ini, f) AS s0, coalesce(ini, f) - c AS lv FROM cd, sn),
cr AS (SELECT *, min(CASE WHEN lv <= rp THEN ds END) OVER (PARTITION BY Series, scenario) AS rd FROM cl),
ca AS (SELECT Series, scenario, max(s0) AS start_level, min(rd) AS reorder_date, min(ds) FILTER (lv < ss) AS safety_date, min(ds) FILTER (lv <= 0) AS stock_out_date, min(CAST(rd + lt AS DATE)) AS arrival_date,
 max(ds) AS e, min(ds) AS b, max(ss) AS ss, sum(d) FILTER (ds > rd AND ds <= rd + lt) AS ld, min(lv) FILTER (ds <= rd + lt) AS lf FROM cr GROUP BY 1, 2),
cv AS (SELECT Series, scenario, start_level, reorder_date, safety_date, stock_out_date, arrival_date, stock_out_date - b AS cover_days, CASE WHEN arrival_date <= e THEN ld END AS lead_demand,
 CASE WHEN arrival_date <= e THEN lf END AS level_before_arrival, CASE WHEN arrival_date <= e THEN greatest(0, ss - lf) END AS short_of_safety, coalesce(stock_out_date <= arrival_date, false) AS late FROM ca)"""


def cover(spark, sf):
    return P.stock_cover(simple_forecasts(spark, sf).where("model = 'Trend'"), rows_of(spark, _SCENARIOS, P.SCENARIO), K)


@query("in15_stock_cover", "Series:s scenario:s start_level:d reorder_date:s safety_date:s stock_out_date:s arrival_date:s cover_days:l lead_demand:d level_before_arrival:d short_of_safety:d late:b",
       f"{_W}, {_SC}, {_COVER}\nFINAL SELECT * FROM cv", places=3)
def _(spark, sf):
    return cover(spark, sf)


@query("in17_cover_comparison", "Series:s scenario:s late:b cover_days:l short_of_safety:d rank:l", f"""{_W}, {_SC}, {_COVER}
FINAL SELECT Series, scenario, late, cover_days, short_of_safety, row_number() OVER (PARTITION BY Series ORDER BY late, stock_out_date IS NULL DESC, cover_days DESC, short_of_safety ASC NULLS LAST, scenario) AS rank FROM cv""", places=3)
def _(spark, sf):
    return P.compare_cover(cover(spark, sf), K)
