"""Parsing, cleaning, winsorizing and scaling."""

from pyspark.sql import functions as F

from stocktide.functions import scalars as X
from stocktide.operators import clean as C
from stocktide.operators import series as S
from stocktide.sources import tables as T

from .registry import query


@query("pf01_parse_dates", "seq:l Date:s", "SELECT seq, Date FROM readings")
def _(spark, sf):
    return T.raw_readings(spark, sf).withColumn("Date", X.parse_date(F.col("Date"), "dd/MM/yyyy"))


@query("pf02_coerce", "seq:l number:d number_or_zero:d whole:l text:s",
       """SELECT seq, Inventory_Level AS number, coalesce(Inventory_Level, 0) AS number_or_zero,
 CAST(trunc(coalesce(Inventory_Level, 0)) AS BIGINT) AS whole, coalesce(CAST(Date AS VARCHAR), '') AS text FROM readings""")
def _(spark, sf):
    raw = T.raw_readings(spark, sf)
    level = F.col("Inventory_Level")
    return raw.select(
        "seq", X.to_number(level).alias("number"), X.to_number(level, 0).alias("number_or_zero"),
        X.to_integer(level).alias("whole"), X.to_text(X.parse_date(F.col("Date"), "dd/MM/yyyy")).alias("text"))


@query("pf03_drop_incomplete", "how:s seq:l Date:s Inventory_Level:d",
       """SELECT 'any' AS how, seq, Date, Inventory_Level FROM readings WHERE Date IS NOT NULL AND Inventory_Level IS NOT NULL
 UNION ALL SELECT 'all', seq, Date, Inventory_Level FROM readings WHERE Date IS NOT NULL OR Inventory_Level IS NOT NULL""")
def _(spark, sf):
    df = C.typed(T.raw_readings(spark, sf), "inventory", "dd/MM/yyyy")
    crit = ["Date", "Inventory_Level"]
    return C.drop_incomplete(df, crit, "any").withColumn("how", F.lit("any")).unionByName(
        C.drop_incomplete(df, crit, "all").withColumn("how", F.lit("all")))


@query("pf04_fill_missing", "seq:l level:d zero:d label:s",
       """SELECT seq, coalesce(Inventory_Level, (SELECT quantile_cont(Inventory_Level, 0.5) FROM readings)) AS level,
 coalesce(Inventory_Level, 0) AS zero, coalesce(CAST(Date AS VARCHAR), 'Unknown') AS label FROM readings""")
def _(spark, sf):
    df = C.typed(T.raw_readings(spark, sf), "inventory", "dd/MM/yyyy").select(
        "seq", F.col("Inventory_Level").alias("level"), F.col("Inventory_Level").alias("zero"), F.col("Date").cast("string").alias("label"))
    return C.fill_missing(df, medians=["level"], zeros=["zero"], unknown=["label"])


def _clip_sql(table, cols, part=""):
    """Clip each column of a table to its 1 % and 99 % quantiles."""
    over = "OVER (PARTITION BY period)" if part else "OVER ()"
    q = [f"quantile_cont({c}, {p}) {over} AS {n}_{c}" for c in cols for p, n in ((0.01, "lo"), (0.99, "hi"))]
    out = [f"CASE WHEN {c} < lo_{c} THEN lo_{c} WHEN {c} > hi_{c} THEN hi_{c} ELSE {c} END AS {c}" for c in cols]
    return f"(SELECT * REPLACE ({', '.join(out)}) FROM (SELECT *, {', '.join(q)} FROM {table}))"


_FLOW = "Row_Id:s Date:s Quantity:d GIK_Per_Unit:d Total_GIK:d"


@query("pf05_live_clean", _FLOW + " Total_EI:d EI_Per_Unit:d",
       f"SELECT * FROM {_clip_sql('outflows', ['GIK_Per_Unit', 'Total_GIK', 'EI_Per_Unit', 'Total_EI'])}")
def _(spark, sf):
    out = T.outflows(spark, sf, ["Row_Id", "Date", "Quantity", "GIK_Per_Unit", "Total_GIK", "EI_Per_Unit", "Total_EI"])
    return C.clean_live(out.withColumn("Date", F.col("Date").cast("string")), "outflows")


@query("pf06_clean_inventory", "seq:l Date:s Inventory_Level:d",
       "SELECT * FROM readings WHERE Date IS NOT NULL AND Inventory_Level IS NOT NULL")
def _(spark, sf):
    return C.clean_table(T.raw_readings(spark, sf), "inventory", "dd/MM/yyyy")


@query("pf06_clean_inflows", _FLOW + " Vendor:s Brand:s", f"SELECT * FROM {_clip_sql('inflows', ['Total_GIK'])}")
def _(spark, sf):
    return C.clean_table(T.inflows(spark, sf), "inflows")


@query("pf06_clean_outflows", _FLOW + " Partner:s Brand:s", f"SELECT * FROM {_clip_sql('outflows', ['Total_GIK'])}")
def _(spark, sf):
    return C.clean_table(T.outflows(spark, sf), "outflows")


@query("pf07_prepare_stock", "Date:s Inventory_Level:d Year:l Month:l Quarter:l DayOfWeek:l DayOfYear:l Inventory_Lag1:d Inventory_Lag7:d Inventory_MA7:d Inventory_MA30:d Inventory_Change:d Inventory_PctChange:d Inventory_Level_Scaled:d", """
WITH d AS (SELECT Date, max(seq) AS seq FROM readings WHERE Date IS NOT NULL GROUP BY 1),
l AS (SELECT d.Date, CAST(d.Date - DATE '1970-01-01' AS DOUBLE) AS x, r.Inventory_Level AS v FROM d JOIN readings r ON r.seq = d.seq),
nb AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER p AS x0, last_value(v IGNORE NULLS) OVER p AS y0,
 first_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER n AS x1, first_value(v IGNORE NULLS) OVER n AS y1 FROM l
 WINDOW p AS (ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (ORDER BY Date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT Date, coalesce(v, y0 + (y1 - y0) * (x - x0) / nullif(x1 - x0, 0), y0) AS v FROM nb),
m AS (SELECT Date, coalesce(v, (SELECT quantile_cont(v, 0.5) FROM i)) AS v FROM i),
q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM m),
c AS (SELECT Date, least(greatest(v, a - 1.5 * (b - a)), b + 1.5 * (b - a)) AS v FROM m, q),
s AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS mid, quantile_cont(v, 0.75) AS b FROM c)
FINAL SELECT Date, v AS Inventory_Level, year(Date) AS Year, month(Date) AS Month, quarter(Date) AS Quarter, isodow(Date) - 1 AS DayOfWeek,
 dayofyear(Date) AS DayOfYear, lag(v) OVER o AS Inventory_Lag1, lag(v, 7) OVER o AS Inventory_Lag7,
 CASE WHEN count(*) OVER w7 = 7 THEN avg(v) OVER w7 END AS Inventory_MA7, CASE WHEN count(*) OVER w30 = 30 THEN avg(v) OVER w30 END AS Inventory_MA30,
 v - lag(v) OVER o AS Inventory_Change, v / lag(v) OVER o - 1 AS Inventory_PctChange, (v - mid) / (b - a) AS Inventory_Level_Scaled
FROM c, s WINDOW o AS (ORDER BY Date), w7 AS (ORDER BY Date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (ORDER BY Date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return C.prepare_stock(T.raw_readings(spark, sf), ["seq"], "dd/MM/yyyy")


@query("pf07_prepare_flows", _FLOW + " Year:l DayOfWeek:l Total_Value:d Product_Type_Encoded:l Category_Encoded:l", """
WITH k AS (SELECT Category, row_number() OVER (ORDER BY Category) - 1 AS code FROM (SELECT DISTINCT Category FROM inflows)),
p AS (SELECT quantile_cont(GIK_Per_Unit, 0.99) AS g, quantile_cont(Quantity, 0.99) AS h FROM inflows),
c AS (SELECT inflows.* REPLACE (CASE WHEN GIK_Per_Unit > 10 * g THEN g ELSE GIK_Per_Unit END AS GIK_Per_Unit, CASE WHEN Quantity > 5 * h THEN h ELSE Quantity END AS Quantity) FROM inflows, p)
FINAL SELECT c.*, year(Date) AS Year, isodow(Date) - 1 AS DayOfWeek, Quantity * GIK_Per_Unit AS Total_Value, code AS Product_Type_Encoded, code AS Category_Encoded FROM c JOIN k USING (Category)""")
def _(spark, sf):
    return C.prepare_flows(T.inflows(spark, sf, ["Row_Id", "Date", "Quantity", "GIK_Per_Unit", "Total_GIK", "Product_Type", "Category"]), "inflows")


@query("pf08_process_periods", "table:s period:s rows:l value:d",
       f"""SELECT 'inventory' AS "table", period, count(*) AS rows, sum(Inventory_Level) AS value FROM inventory GROUP BY period
 UNION ALL SELECT 'inflows', period, count(*), sum(Total_GIK) FROM {_clip_sql('inflows', ['Total_GIK'], 'p')} GROUP BY period
 UNION ALL SELECT 'outflows', period, count(*), sum(Total_GIK) FROM {_clip_sql('outflows', ['Total_GIK'], 'p')} GROUP BY period
 UNION ALL SELECT 'warehouse_features', CASE WHEN Date < DATE '1998-01-01' THEN 'train' WHEN Date < DATE '2000-01-01' THEN 'tune' ELSE 'test' END, count(DISTINCT Date), sum(Quantity) FILTER (flow = 'inflows') FROM flows GROUP BY 2
 UNION ALL SELECT 'category_features', CASE WHEN Date < DATE '1998-01-01' THEN 'train' WHEN Date < DATE '2000-01-01' THEN 'tune' ELSE 'test' END, count(DISTINCT Date), sum(Quantity) FILTER (flow = 'inflows') FROM flows GROUP BY 2""", places=2)
def _(spark, sf):
    cols = ["Date", "Quantity", "Warehouse", "Category", "Total_GIK", "period"]
    done = C.process_periods(T.inventory(spark, sf), T.inflows(spark, sf, cols), T.outflows(spark, sf, cols))
    measure = {"inventory": "Inventory_Level", "inflows": "Total_GIK", "outflows": "Total_GIK",
               "warehouse_features": "Total_Daily_Inflows", "category_features": "Total_Category_Inflows"}
    parts = []
    for name, df in done.items():
        df = df if "period" in df.columns else df.withColumn("period", T.period_of(F.col("Date")))
        parts.append(df.groupBy("period").agg(F.count(F.lit(1)).alias("rows"), F.sum(measure[name]).alias("value")).withColumn("table", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("pf09_keep_last", "Date:s Inventory_Level:d seq:l",
       "SELECT Date, arg_max(Inventory_Level, seq) AS Inventory_Level, max(seq) AS seq FROM snapshots GROUP BY 1")
def _(spark, sf):
    return S.keep_last(T.snapshots(spark, sf).drop("Series"), [], "Date", ["seq"])


@query("pf10_date_range", "Row_Id:s Date:s", "SELECT Row_Id, Date FROM inflows WHERE Date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'")
def _(spark, sf):
    return C.between_dates(T.inflows(spark, sf, ["Row_Id", "Date"]), "1997-03-01", "1998-02-28")


@query("pf11_equality_filters", "Row_Id:s Warehouse:s Category:s",
       "SELECT Row_Id, Warehouse, Category FROM inflows WHERE Warehouse = 'NATION_3' AND Category = 'PROMO'")
def _(spark, sf):
    return C.matching(T.inflows(spark, sf, ["Row_Id", "Warehouse", "Category"]), Warehouse="NATION_3", Category="PROMO", Absent="x")


@query("pf12_selection", "flow:s Row_Id:s Warehouse:s Category:s",
       "SELECT flow, Row_Id, Warehouse, Category FROM flows WHERE Warehouse IN ('NATION_1', 'NATION_3', 'NATION_7') AND Category IN ('PROMO', 'SMALL')")
def _(spark, sf):
    return C.selected(T.flow_datasets(spark, sf, ["Row_Id", "Warehouse", "Category"]),
                      Warehouse=["NATION_1", "NATION_3", "NATION_7"], Category=["PROMO", "SMALL"])


@query("pf13_positive_quantity", "Row_Id:s net:d", "SELECT Row_Id, Total_GIK - 40000 AS net FROM outflows WHERE Total_GIK - 40000 > 0")
def _(spark, sf):
    net = T.outflows(spark, sf, ["Row_Id", "Total_GIK"]).withColumn("net", F.col("Total_GIK") - 40000)
    return C.positive(net, "net")


@query("pf14_calendar_columns", "Date:s year:l month:l day:l quarter:l dayofweek:l dayofyear:l weekofyear:l dayname:s",
       """SELECT Date, year(Date) AS year, month(Date) AS month, day(Date) AS day, quarter(Date) AS quarter, isodow(Date) - 1 AS dayofweek,
 dayofyear(Date) AS dayofyear, weekofyear(Date) AS weekofyear, dayname(Date) AS dayname FROM inventory""")
def _(spark, sf):
    return T.inventory(spark, sf).withColumns(S.calendar_columns("Date"))


@query("pf15_derived_value", "Row_Id:s value:d", "SELECT Row_Id, Quantity * GIK_Per_Unit AS value FROM inflows")
def _(spark, sf):
    return T.inflows(spark, sf, ["Row_Id", "Quantity", "GIK_Per_Unit"]).withColumn("value", F.col("Quantity") * F.col("GIK_Per_Unit"))


@query("pf16_label_codes", "Row_Id:s Brand:s code:l",
       "SELECT Row_Id, Brand, dense_rank() OVER (ORDER BY Brand) - 1 AS code FROM inflows")
def _(spark, sf):
    return C.label_codes(T.inflows(spark, sf, ["Row_Id", "Brand"]), "Brand", "code")


@query("pf17_safe_arithmetic", "month:s quotient:d change:d growth:d",
       """SELECT month, CASE WHEN o IS NULL OR o = 0 THEN 0 ELSE i / o END AS quotient,
 coalesce((o - i) * 100 / nullif(abs(i), 0), 0) AS change,
 CASE WHEN i > 0 AND o > 0 THEN (pow(o / i, 1.0 / 12) - 1) * 100 ELSE 0 END AS growth FROM (
 SELECT strftime(Date, '%Y-%m') AS month, sum(Quantity) FILTER (flow = 'inflows') AS i, sum(Quantity) FILTER (flow = 'outflows') AS o FROM flows GROUP BY 1)""")
def _(spark, sf):
    from stocktide.operators.aggregates import monthly_flows

    i, o = F.col("inflow"), F.col("outflow")
    return monthly_flows(T.flow_datasets(spark, sf, ["Date", "Quantity"])).select(
        "month", X.safe_divide(i, o).alias("quotient"), X.percent_change(i, o).alias("change"),
        X.compound_growth(i, o, F.lit(12)).alias("growth"))


@query("pf18_normalize", "method:s Series:s Date:s normalized:d", """
WITH p AS (SELECT Series, min(Inventory_Level) AS a, max(Inventory_Level) AS b, avg(Inventory_Level) AS m, stddev(Inventory_Level) AS sd,
 quantile_cont(Inventory_Level, 0.5) AS md FROM stock GROUP BY 1),
r AS (SELECT Series, quantile_cont(abs(Inventory_Level - md), 0.5) AS mad FROM stock JOIN p USING (Series) GROUP BY 1)
FINAL SELECT 'minmax' AS method, Series, Date, (Inventory_Level - a) / (b - a) AS normalized FROM stock JOIN p USING (Series)
UNION ALL SELECT 'zscore', Series, Date, (Inventory_Level - m) / sd FROM stock JOIN p USING (Series)
UNION ALL SELECT 'robust', Series, Date, (Inventory_Level - md) / mad FROM stock JOIN p USING (Series) JOIN r USING (Series)""")
def _(spark, sf):
    stock = T.inventory(spark, sf, by_priority=True)
    a, b, c = (C.normalize(stock, "Inventory_Level", m, ["Series"]).withColumn("method", F.lit(m)) for m in ("minmax", "zscore", "robust"))
    return a.unionByName(b).unionByName(c)


@query("pf19_standard_scale", "Series:s Date:s scaled:d restored:d", """
WITH p AS (SELECT Series, avg(Inventory_Level) AS m, stddev_pop(Inventory_Level) AS sd FROM stock WHERE period = 'train' GROUP BY 1)
FINAL SELECT Series, Date, (Inventory_Level - m) / sd AS scaled, Inventory_Level AS restored FROM stock JOIN p USING (Series) WHERE period = 'tune'""")
def _(spark, sf):
    stock = T.inventory(spark, sf, by_priority=True)
    p = C.scale_parameters(stock.where("period = 'train'"), "Inventory_Level", ["Series"])
    scaled = C.standardize(stock.where("period = 'tune'"), p, ["Inventory_Level"], ["Series"]).withColumnRenamed("Inventory_Level", "scaled")
    return C.standardize(scaled.withColumn("restored", F.col("scaled")), p, ["restored"], ["Series"], inverse=True)


@query("pf20_robust_scale", "Series:s Date:s scaled:d", """
WITH p AS (SELECT Series, quantile_cont(Inventory_Level, 0.25) AS a, quantile_cont(Inventory_Level, 0.5) AS m, quantile_cont(Inventory_Level, 0.75) AS b FROM stock GROUP BY 1)
FINAL SELECT Series, Date, (Inventory_Level - m) / (b - a) AS scaled FROM stock JOIN p USING (Series)""")
def _(spark, sf):
    return C.robust_scale(T.inventory(spark, sf, by_priority=True), "Inventory_Level", "scaled", ["Series"])


@query("wz01_winsorize", "Row_Id:s Total_GIK:d", f"SELECT Row_Id, Total_GIK FROM {_clip_sql('inflows', ['Total_GIK'])}")
def _(spark, sf):
    return C.winsorize(T.inflows(spark, sf, ["Row_Id", "Total_GIK"]), "Total_GIK")


@query("wz01_winsorize_by_category", "Row_Id:s Category:s Total_GIK:d", """
WITH q AS (SELECT Category, quantile_cont(Total_GIK, 0.05) AS a, quantile_cont(Total_GIK, 0.95) AS b FROM outflows GROUP BY 1)
FINAL SELECT Row_Id, Category, least(greatest(Total_GIK, a), b) AS Total_GIK FROM outflows JOIN q USING (Category)""")
def _(spark, sf):
    return C.winsorize(T.outflows(spark, sf, ["Row_Id", "Category", "Total_GIK"]), "Total_GIK", ["Category"], 0.05, 0.95)


@query("wz02_clip_to_fence", "Series:s Date:s Inventory_Level:d", """
WITH q AS (SELECT Series, quantile_cont(Inventory_Level, 0.25) AS a, quantile_cont(Inventory_Level, 0.75) AS b FROM stock GROUP BY 1)
FINAL SELECT Series, Date, least(greatest(Inventory_Level, a - 1.5 * (b - a)), b + 1.5 * (b - a)) AS Inventory_Level FROM stock JOIN q USING (Series)""")
def _(spark, sf):
    return C.clip_to_fence(T.inventory(spark, sf, by_priority=True), "Inventory_Level", ["Series"])


@query("wz03_cap_extremes", "Row_Id:s Total_GIK:d", """
WITH q AS (SELECT quantile_cont(Total_GIK, 0.99) AS p FROM inflows)
FINAL SELECT Row_Id, CASE WHEN Total_GIK > p * 0.9 THEN p ELSE Total_GIK END AS Total_GIK FROM inflows, q""")
def _(spark, sf):
    # No value exceeds five times its percentile here; a factor below 1 shows the rule.
    return C.cap_extremes(T.inflows(spark, sf, ["Row_Id", "Total_GIK"]), {"Total_GIK": 0.9})


@query("wz04_winsorize_by_rank", "Row_Id:s Total_GIK:d", """
WITH r AS (SELECT Total_GIK AS v, row_number() OVER (ORDER BY Total_GIK) - 1 AS i, count(*) OVER () AS n FROM inflows),
b AS (SELECT max(v) FILTER (i = CAST(floor(0.01 * n) AS BIGINT)) AS lo, max(v) FILTER (i = n - 1 - CAST(floor(0.01 * n) AS BIGINT)) AS hi FROM r)
FINAL SELECT Row_Id, least(greatest(Total_GIK, lo), hi) AS Total_GIK FROM inflows, b""")
def _(spark, sf):
    return C.winsorize_by_rank(T.inflows(spark, sf, ["Row_Id", "Total_GIK"]), "Total_GIK")
