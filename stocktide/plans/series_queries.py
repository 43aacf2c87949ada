"""Daily series per order priority: calendars, filling, trends."""

from pyspark.sql import functions as F

from stocktide.operators import aggregates as A
from stocktide.operators import series as S
from stocktide.sources import tables as T

from .registry import query

K, D, V = ["Series"], "Date", "Inventory_Level"
_W = "OVER (PARTITION BY Series ORDER BY Date)"
# Calendar spine per series and the levels on it.
_CAL = """ends AS (SELECT Series, min(Date) AS a, max(Date) AS b FROM stock GROUP BY 1),
cal AS (SELECT Series, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS Date FROM ends),
grid AS (SELECT c.Series, c.Date, s.Inventory_Level FROM cal c LEFT JOIN stock s USING (Series, Date))"""
_FFILL = """last_value(Inventory_Level IGNORE NULLS) OVER (PARTITION BY Series ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
_BFILL = """first_value(Inventory_Level IGNORE NULLS) OVER (PARTITION BY Series ORDER BY Date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
_FRAME = f"{_CAL},\nframe AS (SELECT Series, Date AS ds, coalesce({_FFILL}, {_BFILL}) AS y FROM grid)"


def stock(spark, sf):
    return T.inventory(spark, sf, by_priority=True)


@query("ts01_calendar_spine", "Series:s Date:s", f"WITH {_CAL}\nFINAL SELECT * FROM cal")
def _(spark, sf):
    return S.spine(stock(spark, sf), K, D)


@query("ts02_fill_both_ways", "Series:s Date:s Inventory_Level:d",
       f"WITH {_CAL}\nFINAL SELECT Series, Date, coalesce({_FFILL}, {_BFILL}) AS Inventory_Level FROM grid")
def _(spark, sf):
    return S.fill(S.on_calendar(stock(spark, sf), K, D), K, D, [V])


_PREV = "last_value(CASE WHEN Inventory_Level IS NOT NULL THEN {x} END IGNORE NULLS) OVER (PARTITION BY Series ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_NEXT = "first_value(CASE WHEN Inventory_Level IS NOT NULL THEN {x} END IGNORE NULLS) OVER (PARTITION BY Series ORDER BY Date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _interp(source, at):
    return f"""pos AS (SELECT *, {at} AS x FROM {source}),
nb AS (SELECT *, {_PREV.format(x='x')} AS x0, {_PREV.format(x='Inventory_Level')} AS y0,
 {_NEXT.format(x='x')} AS x1, {_NEXT.format(x='Inventory_Level')} AS y1 FROM pos),
line AS (SELECT Series, Date, coalesce(Inventory_Level, y0 + (y1 - y0) * (x - x0) / nullif(x1 - x0, 0), y0) AS Inventory_Level FROM nb)"""


@query("ts03_gap_fill_methods", "method:s Series:s Date:s Inventory_Level:d", f"""
WITH {_CAL}, {_interp('grid', f'row_number() {_W}')}
FINAL SELECT 'ffill' AS method, Series, Date, {_FFILL} AS Inventory_Level FROM grid
UNION ALL SELECT 'bfill', Series, Date, {_BFILL} FROM grid
UNION ALL SELECT 'zero', Series, Date, coalesce(Inventory_Level, 0) FROM grid
UNION ALL SELECT 'interpolate', Series, Date, Inventory_Level FROM line""")
def _(spark, sf):
    base = stock(spark, sf).select("Series", "Date", V)
    return S.fill_methods(base, K, D, [V], ("ffill", "bfill", "zero", "interpolate"))


@query("ts04_interpolate_by_time", "Date:s seq:l Inventory_Level:d", f"""
WITH dd AS (SELECT Date, max_by(CASE WHEN Inventory_Level > 50000 THEN Inventory_Level ELSE -1 END, seq) AS lv, max(seq) AS seq FROM snapshots GROUP BY 1),
src AS (SELECT 'all' AS Series, Date, seq, nullif(lv, -1) AS Inventory_Level FROM dd), {_interp('src', "CAST(Date - DATE '1970-01-01' AS DOUBLE)")}
FINAL SELECT line.Date, seq, line.Inventory_Level FROM line JOIN dd USING (Date)""")
def _(spark, sf):
    # Readings at or below 50,000 count as missing.
    last = S.keep_last(T.snapshots(spark, sf).drop("Series"), [], D, ["seq"])
    masked = last.withColumn(V, F.when(F.col(V) > 50000, F.col(V)))
    return S.interpolate(masked, [], D, V, by="time")


@query("ts05_model_frame", "Series:s ds:s y:d", f"""
WITH lastd AS (SELECT Series, Date, arg_max(Inventory_Level, seq) AS Inventory_Level FROM snapshots GROUP BY 1, 2), {_CAL.replace("FROM stock", "FROM lastd").replace("JOIN stock", "JOIN lastd")}
FINAL SELECT Series, Date AS ds, coalesce({_FFILL}, {_BFILL}) AS y FROM grid""")
def _(spark, sf):
    return S.model_frame(T.snapshots(spark, sf), K, order=["seq"])


@query("ts06_frame_with_flow_features", "Series:s ds:s y:d Total_Daily_Inflows:d Total_Daily_Outflows:d Active_Warehouses:l Warehouse_Diversity:d Total_Category_Inflows:d Active_Categories:l", f"""
WITH {_FRAME}, f AS (SELECT Date AS ds, sum(Quantity) FILTER (flow = 'inflows') AS i, sum(Quantity) FILTER (flow = 'outflows') AS o,
 count(DISTINCT Warehouse) AS w, count(DISTINCT Category) AS c FROM flows GROUP BY 1)
FINAL SELECT Series, ds, y, coalesce(i, 0) AS Total_Daily_Inflows, coalesce(o, 0) AS Total_Daily_Outflows, coalesce(w, 0) AS Active_Warehouses,
 coalesce(1 - 1.0 / w, 0) AS Warehouse_Diversity, coalesce(i, 0) AS Total_Category_Inflows, coalesce(c, 0) AS Active_Categories FROM frame LEFT JOIN f USING (ds)""")
def _(spark, sf):
    cols = ["Date", "Quantity", "Warehouse", "Category"]
    fin, fout = T.inflows(spark, sf, cols), T.outflows(spark, sf, cols)
    frame = S.model_frame(stock(spark, sf), K)
    return S.with_flow_features(frame, A.warehouse_features(fin, fout), A.category_features(fin, fout))


@query("ts07_lags", "Series:s Date:s lag_1:d lag_7:d lag_30:d",
       f"SELECT Series, Date, lag(Inventory_Level, 1) {_W} AS lag_1, lag(Inventory_Level, 7) {_W} AS lag_7, lag(Inventory_Level, 30) {_W} AS lag_30 FROM stock")
def _(spark, sf):
    return S.lags(stock(spark, sf), K, D, V)


def _roll_sql(w, need):
    fr = f"OVER (PARTITION BY Series ORDER BY Date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    c = lambda f, n: f"CASE WHEN count(*) {fr} >= {need} THEN {f}(Inventory_Level) {fr} END AS {n}"
    return f"SELECT {w} AS width, Series, Date, {c('avg', 'mean')}, {c('stddev', 'std')}, {c('max', 'max')}, {c('min', 'min')} FROM stock"


@query("ts08_rolling_stats", "width:l Series:s Date:s mean:d std:d max:d min:d", f"{_roll_sql(7, 1)} UNION ALL {_roll_sql(30, 30)}", places=3)
def _(spark, sf):
    def one(w, need):
        r = S.rolling(K, D, V, w, need)
        return stock(spark, sf).select(F.lit(w).alias("width"), *K, D, *[r[f"rolling_{n}_{w}"].alias(n) for n in ("mean", "std", "max", "min")])

    return one(7, 1).unionByName(one(30, 30))


_CHG = f"""chg AS (SELECT Series, Date, Inventory_Level - lag(Inventory_Level) {_W} AS diff,
 Inventory_Level / nullif(lag(Inventory_Level) {_W}, 0) - 1 AS pct_change FROM stock)"""


@query("ts09_changes", "Series:s Date:s diff:d pct_change:d", f"WITH {_CHG}\nFINAL SELECT * FROM chg")
def _(spark, sf):
    return S.changes(stock(spark, sf), K, D, V)


@query("ts09_change_profile", "Series:s daily_volatility:d max_daily_change:d avg_daily_change:d", f"""
WITH {_CHG}
FINAL SELECT Series, stddev(pct_change) AS daily_volatility, max(abs(pct_change)) AS max_daily_change, avg(pct_change) AS avg_daily_change FROM chg GROUP BY 1""")
def _(spark, sf):
    return S.change_profile(stock(spark, sf), K, D, V)


@query("ts10_turning_points", "Series:s Date:s Inventory_Level:d kind:s", """
WITH r AS (SELECT *, count(*) OVER w AS n, max(Inventory_Level) OVER w AS hi, min(Inventory_Level) OVER w AS lo FROM stock
 WINDOW w AS (PARTITION BY Series ORDER BY Date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
FINAL SELECT Series, Date, Inventory_Level, 'peak' AS kind FROM r WHERE n = 30 AND Inventory_Level = hi
UNION ALL SELECT Series, Date, Inventory_Level, 'trough' FROM r WHERE n = 30 AND Inventory_Level = lo""")
def _(spark, sf):
    return S.turning_points(stock(spark, sf), K, D, V)


@query("ts11_growth_between_ends", "Series:s rows:l early_avg:d recent_avg:d growth:d rapid:b", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY Series ORDER BY Date) AS a, row_number() OVER (PARTITION BY Series ORDER BY Date DESC) AS d FROM stock),
g AS (SELECT Series, count(*) AS rows, avg(Inventory_Level) FILTER (a <= 30) AS early_avg, avg(Inventory_Level) FILTER (d <= 30) AS recent_avg FROM r GROUP BY 1)
FINAL SELECT *, (recent_avg - early_avg) / early_avg AS growth, (recent_avg - early_avg) / early_avg > 0.5 AS rapid FROM g WHERE rows > 30""")
def _(spark, sf):
    return S.growth_between_ends(stock(spark, sf), K, D, V)


@query("ts12_positional_split", "Series:s Date:s part:l", """
WITH r AS (SELECT Series, Date, row_number() OVER (PARTITION BY Series ORDER BY Date) - 1 AS i, count(*) OVER (PARTITION BY Series) AS n FROM stock)
FINAL SELECT Series, Date, least(i // (n // 3), 2) AS part FROM r""")
def _(spark, sf):
    return S.positional_split(stock(spark, sf), K, D, 3)


@query("ts13_cv_folds", "Series:s Date:s fold:l role:s", """
WITH r AS (SELECT Series, Date, row_number() OVER (PARTITION BY Series ORDER BY Date) - 1 AS i, count(*) OVER (PARTITION BY Series) AS n FROM stock),
f AS (SELECT *, n // 4 AS s, n - (n // 4) * (3 - fold) AS st FROM r, unnest([0, 1, 2]) AS u(fold))
FINAL SELECT Series, Date, fold, CASE WHEN i < st THEN 'train' ELSE 'test' END AS role FROM f WHERE i < st + s""")
def _(spark, sf):
    return S.cv_folds(stock(spark, sf), K, D)


_WEEK = "CAST(date_trunc('week', Date) AS DATE)"
_MONTH = "CAST(date_trunc('month', Date) AS DATE)"


def _resample_sql(name, bucket, step, label):
    return f"""SELECT '{name}' AS grain, Warehouse, {label} AS Date, coalesce(q, 0) AS Quantity, coalesce(g, 0) AS Total_GIK FROM (
 SELECT Warehouse, CAST(unnest(generate_series(min({bucket}), max({bucket}), INTERVAL 1 {step})) AS DATE) AS b FROM outflows GROUP BY 1)
 LEFT JOIN (SELECT Warehouse, {bucket} AS b, sum(Quantity) AS q, sum(Total_GIK) AS g FROM outflows GROUP BY 1, 2) USING (Warehouse, b)"""


@query("ts14_resample", "grain:s Warehouse:s Date:s Quantity:d Total_GIK:d",
       " UNION ALL ".join([_resample_sql("D", "Date", "DAY", "b"), _resample_sql("W", _WEEK, "WEEK", "b + 6"), _resample_sql("M", _MONTH, "MONTH", "last_day(b)")]))
def _(spark, sf):
    out = T.outflows(spark, sf, ["Warehouse", "Date", "Quantity", "Total_GIK"])
    how = {"Quantity": "sum", "Total_GIK": "sum"}
    return S.resample_all(out, "DWM", columns=how, keys=["Warehouse"])


_IDX = "idx AS (SELECT *, CAST(row_number() OVER (PARTITION BY Series ORDER BY Date) - 1 AS DOUBLE) AS i FROM stock)"
_FIT = f"{_IDX}, fit AS (SELECT Series, regr_slope(Inventory_Level, i) AS slope, regr_intercept(Inventory_Level, i) AS intercept, regr_r2(Inventory_Level, i) AS r2, count(*) AS n FROM idx GROUP BY 1)"


@query("ts15_linear_trend", "Series:s slope:d intercept:d r2:d n:l direction:s",
       f"WITH {_FIT}\nFINAL SELECT *, CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM fit")
def _(spark, sf):
    return S.linear_trend(stock(spark, sf), K, D, V)


@query("ts16_detrend", "Series:s Date:s trend:d detrended:d",
       f"WITH {_FIT}\nFINAL SELECT Series, Date, slope * i + intercept AS trend, Inventory_Level - (slope * i + intercept) AS detrended FROM idx JOIN fit USING (Series)")
def _(spark, sf):
    return S.detrend(stock(spark, sf), K, D, V)


def _decomp(period):
    h = period // 2
    w = f"OVER (PARTITION BY Series ORDER BY ds ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    o = "OVER (PARTITION BY Series ORDER BY ds)"
    edge = f"- (lag(y, {h}) {o} + lead(y, {h}) {o}) / 2" if period % 2 == 0 else ""
    return f"""tr AS (SELECT *, (row_number() {o} - 1) % {period} AS ph, CASE WHEN count(y) {w} = {2 * h + 1} THEN (sum(y) {w} {edge}) / {period} END AS trend FROM frame),
ph AS (SELECT Series, ph, avg(y - trend) AS m FROM tr GROUP BY 1, 2), se AS (SELECT Series, ph, m - avg(m) OVER (PARTITION BY Series) AS seasonal FROM ph),
dec AS (SELECT tr.*, seasonal, y - trend - seasonal AS resid FROM tr JOIN se USING (Series, ph))"""


def frame(spark, sf):
    return S.model_frame(stock(spark, sf), K)


@query("ts17_decompose", "Series:s ds:s y:d trend:d seasonal:d resid:d", f"WITH {_FRAME}, {_decomp(12)}\nFINAL SELECT * FROM dec", places=3)
def _(spark, sf):
    return S.decompose(frame(spark, sf), K, "ds", "y", 12)


@query("ts18_trend_change", "Series:s early_slope:d late_slope:d change:d changed:b", f"""
WITH {_FRAME}, {_decomp(365)},
t AS (SELECT Series, trend, row_number() OVER (PARTITION BY Series ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY Series) AS n FROM dec WHERE trend IS NOT NULL),
g AS (SELECT Series, regr_slope(trend, i) FILTER (i < n // 2) AS early_slope, regr_slope(trend, i) FILTER (i >= n - n // 2) AS late_slope, stddev(trend) AS sd FROM t GROUP BY 1)
FINAL SELECT Series, early_slope, late_slope, abs(late_slope - early_slope) AS change, abs(late_slope - early_slope) > sd * 0.1 AS changed FROM g""")
def _(spark, sf):
    return S.trend_change(frame(spark, sf), K, "ds", "y")


@query("ts19_long_gaps", "Series:s Date:s gap_days:l",
       f"SELECT * FROM (SELECT Series, Date, Date - lag(Date) {_W} AS gap_days FROM stock) WHERE gap_days > 5")
def _(spark, sf):
    return S.long_gaps(stock(spark, sf), K, D, days=5)


@query("ts19_detrend_if_gapped", "Series:s Date:s trend:d detrended:d", f"""
WITH {_FIT}, g AS (SELECT DISTINCT Series FROM (SELECT Series, Date - lag(Date) {_W} AS gap FROM stock) WHERE gap > 10)
FINAL SELECT Series, Date, CASE WHEN g.Series IS NOT NULL THEN slope * i + intercept END AS trend,
 CASE WHEN g.Series IS NOT NULL THEN Inventory_Level - (slope * i + intercept) END AS detrended FROM idx JOIN fit USING (Series) LEFT JOIN g USING (Series)""")
def _(spark, sf):
    return S.detrend_if_gapped(stock(spark, sf), K, D, V, days=10)


@query("ts19_detrend_gapped", "Series:s Date:s method:s trend:d detrended:d", """
WITH ix AS (SELECT period AS Series, Date, Inventory_Level AS v, CAST(row_number() OVER w - 1 AS DOUBLE) AS i, Date - lag(Date) OVER w AS gap FROM inventory WINDOW w AS (PARTITION BY period ORDER BY Date)),
fi AS (SELECT Series, regr_slope(v, i) AS slope, regr_intercept(v, i) AS intercept, count(*) AS n, count(*) FILTER (gap > 1) AS gaps FROM ix GROUP BY 1),
sm AS (SELECT *, CASE WHEN count(v) OVER w = 365 THEN sum(v) OVER w / 365 END AS t FROM ix WINDOW w AS (PARTITION BY Series ORDER BY Date ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)),
fl AS (SELECT *, coalesce(first_value(t IGNORE NULLS) OVER (PARTITION BY Series ORDER BY Date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
 last_value(t IGNORE NULLS) OVER (PARTITION BY Series ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS f FROM sm),
bo AS (SELECT Series, Date, v, gaps > 0 AS hit, n >= 730 AS long, CASE WHEN n >= 730 THEN f ELSE slope * i + intercept END AS trend FROM fl JOIN fi USING (Series))
FINAL SELECT Series, Date, CASE WHEN hit THEN CASE WHEN long THEN 'decomposition' ELSE 'line' END END AS method, CASE WHEN hit THEN trend END AS trend, CASE WHEN hit THEN v - trend END AS detrended FROM bo""", places=3)
def _(spark, sf):
    return S.detrend_gapped(T.inventory(spark, sf).withColumnRenamed("period", "Series"), K, D, V, days=1)


@query("ts20_seasonality", "Series:s seasonal:b monthly_variation:d weekly_variation:d", """
WITH m AS (SELECT Series, stddev(v) / avg(v) AS mv FROM (SELECT Series, month(Date) AS b, avg(Inventory_Level) AS v FROM stock GROUP BY 1, 2) GROUP BY 1),
w AS (SELECT Series, stddev(v) / avg(v) AS wv FROM (SELECT Series, dayofweek(Date) AS b, avg(Inventory_Level) AS v FROM stock GROUP BY 1, 2) GROUP BY 1)
FINAL SELECT Series, mv > 0.1 OR wv > 0.05 AS seasonal, mv AS monthly_variation, wv AS weekly_variation FROM m JOIN w USING (Series)""")
def _(spark, sf):
    return S.seasonality(stock(spark, sf), K, D, V)


@query("ts21_regressors_into_horizon", "Warehouse:s Date:s quantity:d is_future:b", """
WITH d AS (SELECT Warehouse, Date, sum(Quantity) AS quantity FROM outflows GROUP BY 1, 2),
e AS (SELECT Warehouse, max(Date) AS b, arg_max(quantity, Date) AS q FROM d GROUP BY 1)
FINAL SELECT Warehouse, Date, quantity, false AS is_future FROM d
UNION ALL SELECT Warehouse, b + CAST(unnest(generate_series(1, 30)) AS INTEGER), q, true FROM e""")
def _(spark, sf):
    daily = T.outflows(spark, sf, ["Warehouse", "Date", "Quantity"]).groupBy("Warehouse", "Date").agg(F.sum("Quantity").alias("quantity"))
    return S.carry_into_horizon(daily, ["Warehouse"], "Date", ["quantity"], 30)
