"""Joins, set operations, sorting and pages."""

from pyspark.sql import functions as F

from stocktide.operators import combine as J
from stocktide.operators import series as S
from stocktide.operators.paging import dataset_page, page
from stocktide.sources import tables as T

from .registry import query


@query("js01_full_outer_flows", "Date:s Warehouse:s q_in:d q_out:d", """
WITH a AS (SELECT Date, Warehouse, sum(Quantity) AS q_in FROM inflows GROUP BY 1, 2), b AS (SELECT Date, Warehouse, sum(Quantity) AS q_out FROM outflows GROUP BY 1, 2)
FINAL SELECT Date, Warehouse, coalesce(q_in, 0) AS q_in, coalesce(q_out, 0) AS q_out FROM a FULL JOIN b USING (Date, Warehouse)""")
def _(spark, sf):
    cols, on = ["Date", "Warehouse", "Quantity"], ["Date", "Warehouse"]
    a = T.inflows(spark, sf, cols).groupBy(*on).agg(F.sum("Quantity").alias("q_in"))
    b = T.outflows(spark, sf, cols).groupBy(*on).agg(F.sum("Quantity").alias("q_out"))
    return J.full_outer(a, b, on)


@query("js02_left_on_date", "Date:s Inventory_Level:d Total_Daily_Outflows:d", """
WITH b AS (SELECT Date, sum(Quantity) AS q FROM outflows GROUP BY 1)
FINAL SELECT Date, Inventory_Level, coalesce(q, 0) AS Total_Daily_Outflows FROM inventory LEFT JOIN b USING (Date)""")
def _(spark, sf):
    q = T.outflows(spark, sf, ["Date", "Quantity"]).groupBy("Date").agg(F.sum("Quantity").alias("Total_Daily_Outflows"))
    frame = S.with_flow_features(T.inventory(spark, sf).withColumnRenamed("Date", "ds"), q)
    return frame.withColumnRenamed("ds", "Date")


_NEXT = "SELECT Date, Inventory_Level AS actual, lag(Inventory_Level) OVER (ORDER BY Date) AS yhat FROM inventory"


@query("js03_actual_vs_forecast", "Date:s actual:d yhat:d", f"SELECT * FROM ({_NEXT}) WHERE yhat IS NOT NULL")
def _(spark, sf):
    # The level one reading earlier stands in for a forecast.
    actual = T.inventory(spark, sf).select("Date", F.col("Inventory_Level").alias("actual"))
    lagged = S.lags(T.inventory(spark, sf), [], "Date", "Inventory_Level", (1,)).select("Date", F.col("lag_1").alias("yhat"))
    return actual.join(lagged.where(F.col("yhat").isNotNull()), "Date", "inner")


_SHARES = """sh AS (SELECT {c} AS label, count(*) FILTER (period = 'train') AS n1, count(*) FILTER (period = 'tune') AS n2 FROM {t}
 WHERE period IN ('train', 'tune') GROUP BY 1),
al AS (SELECT label, n1, n2, n1 / sum(n1) OVER () AS p, n2 / sum(n2) OVER () AS q FROM sh)"""


@query("js04_aligned_shares", "Partner:s p:d q:d", f"WITH {_SHARES.format(c='Partner', t='outflows')}\nFINAL SELECT label AS Partner, p, q FROM al")
def _(spark, sf):
    return J.two_sample_shares(T.outflows(spark, sf, ["Partner", "period"]), "Partner", "period", "train", "tune")


@query("js05_new_and_gone", "Partner:s change:s", f"""WITH {_SHARES.format(c='Partner', t='outflows')}
FINAL SELECT label AS Partner, CASE WHEN n1 = 0 THEN 'new' ELSE 'gone' END AS change FROM al WHERE n1 = 0 OR n2 = 0""")
def _(spark, sf):
    return J.label_changes(J.two_sample_shares(T.outflows(spark, sf, ["Partner", "period"]), "Partner", "period", "train", "tune"), "Partner")


@query("js06_in_both_periods", "Partner:s", "SELECT Partner FROM outflows WHERE period = 'train' INTERSECT SELECT Partner FROM outflows WHERE period = 'tune'")
def _(spark, sf):
    out = T.outflows(spark, sf, ["Partner", "period"])
    return out.where("period = 'train'").select("Partner").distinct().join(
        out.where("period = 'tune'").select("Partner"), "Partner", "left_semi")


@query("js07_common_dates", "Date:s", "SELECT Date FROM inflows INTERSECT SELECT Date FROM outflows")
def _(spark, sf):
    return T.inflows(spark, sf, ["Date"]).intersect(T.outflows(spark, sf, ["Date"]))


@query("js08_union_all", "dataset:s Date:s Quantity:d Partner:s", """SELECT 'inflows' AS dataset, Date, Quantity, NULL AS Partner FROM inflows
 UNION ALL SELECT 'outflows', Date, Quantity, Partner FROM outflows""")
def _(spark, sf):
    a = T.inflows(spark, sf, ["Date", "Quantity"]).withColumn("dataset", F.lit("inflows"))
    b = T.outflows(spark, sf, ["Date", "Quantity", "Partner"]).withColumn("dataset", F.lit("outflows"))
    return a.unionByName(b, allowMissingColumns=True)


@query("js09_ordered_page", "Date:s Inventory_Level:d total_records:l",
       "SELECT Date, Inventory_Level, (SELECT count(*) FROM inventory) AS total_records FROM inventory ORDER BY Date LIMIT 25 OFFSET 100")
def _(spark, sf):
    return page(T.inventory(spark, sf), ["Date"], limit=25, offset=100)


@query("js10_top_and_bottom", "side:s Brand:s total:d", """
WITH t AS (SELECT Brand, sum(Total_GIK) AS total FROM inflows GROUP BY 1)
FINAL (SELECT 'top' AS side, Brand, total FROM t ORDER BY total DESC, Brand LIMIT 5) UNION ALL (SELECT 'bottom', Brand, total FROM t ORDER BY total, Brand LIMIT 5)""")
def _(spark, sf):
    t = T.inflows(spark, sf, ["Brand", "Total_GIK"]).groupBy("Brand").agg(F.sum("Total_GIK").alias("total"))
    top = J.top_k(t, "total", 5, "Brand").withColumn("side", F.lit("top"))
    return top.unionByName(J.top_k(t, "total", 5, "Brand", largest=False).withColumn("side", F.lit("bottom")))


@query("js10_top_per_group", "Category:s Warehouse:s total:d", """SELECT Category, Warehouse, total FROM (
 SELECT Category, Warehouse, sum(Quantity) AS total, row_number() OVER (PARTITION BY Category ORDER BY sum(Quantity) DESC, Warehouse) AS r FROM outflows GROUP BY 1, 2) WHERE r <= 3""")
def _(spark, sf):
    t = T.outflows(spark, sf, ["Category", "Warehouse", "Quantity"]).groupBy("Category", "Warehouse").agg(F.sum("Quantity").alias("total"))
    return J.top_k(t, "total", 3, "Warehouse", ["Category"])


@query("js11_extreme_rows", "Series:s side:s Date:s Inventory_Level:d", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY Series ORDER BY Inventory_Level DESC, Date) AS a, row_number() OVER (PARTITION BY Series ORDER BY Inventory_Level, Date) AS b FROM stock)
FINAL SELECT Series, 'max' AS side, Date, Inventory_Level FROM r WHERE a = 1 UNION ALL SELECT Series, 'min', Date, Inventory_Level FROM r WHERE b = 1""")
def _(spark, sf):
    return J.extreme_rows(T.inventory(spark, sf, by_priority=True), "Inventory_Level", "Date", ["Series"])


def _page_sql(table, cols, where, tie, limit, offset):
    return f"""SELECT {cols}, (SELECT count(*) FROM {table} WHERE {where}) AS total_records FROM {table} WHERE {where} ORDER BY {tie} LIMIT {limit} OFFSET {offset}"""


@query("qa1_inventory_page", "Date:s Inventory_Level:d total_records:l",
       _page_sql("inventory", "Date, Inventory_Level", "period = 'tune' AND Date >= DATE '1998-03-01' AND Date <= DATE '1999-03-31'", "Date", 50, 20))
def _(spark, sf):
    return dataset_page(T.inventory(spark, sf), "tune", ["Date"], 50, 20, "1998-03-01", "1999-03-31")


@query("qa2_inflow_page", "Row_Id:s Date:s Quantity:d Warehouse:s Category:s total_records:l",
       _page_sql("inflows", "Row_Id, Date, Quantity, Warehouse, Category", "period = 'train' AND Warehouse = 'NATION_3' AND Category = 'PROMO'", "Date, Row_Id", 20, 5))
def _(spark, sf):
    cols = ["Row_Id", "Date", "Quantity", "Warehouse", "Category", "period"]
    return dataset_page(T.inflows(spark, sf, cols), "train", ["Date", "Row_Id"], 20, 5, Warehouse="NATION_3", Category="PROMO")


@query("qa3_outflow_page", "Row_Id:s Date:s Quantity:d Partner:s total_records:l",
       _page_sql("outflows", "Row_Id, Date, Quantity, Partner", "period = 'train' AND Category = 'SMALL' AND Partner = (SELECT min(Partner) FROM outflows WHERE period = 'train' AND Category = 'SMALL')", "Date, Row_Id", 100, 0))
def _(spark, sf):
    out = T.outflows(spark, sf, ["Row_Id", "Date", "Quantity", "Partner", "Category", "period"])
    first = out.where("period = 'train' and Category = 'SMALL'").agg(F.min("Partner").alias("p")).scalar()
    return dataset_page(out, "train", ["Date", "Row_Id"], 100, 0, Category="SMALL", Partner=first)
