"""Round trips through files, catalogs and exports."""

from pyspark.sql import functions as F

from stocktide.operators import evaluate as E
from stocktide.session import work_path
from stocktide.sources import files
from stocktide.sources import tables as T

from .forecast_queries import FORECAST_SQL, simple_forecasts, tune_levels
from .registry import query

_FLOW = ["Date", "Vendor", "Quantity", "Category", "Brand", "Warehouse", "GIK_Per_Unit", "Total_GIK"]


@query("io01_csv_scan", "Date:s Vendor:s Quantity:d Category:s Brand:s Warehouse:s GIK_Per_Unit:d Total_GIK:d",
       "SELECT * FROM inflows")
def _(spark, sf):
    path = work_path(spark, "csv")
    out = T.inflows(spark, sf, _FLOW).withColumn("Date", F.date_format("Date", "dd/MM/yyyy"))
    files.export_csv(out, path)
    return files.read_csv(spark, path, "inflows", "dd/MM/yyyy")


@query("io02_header_names", "Date:s Inventory_Level:d", "SELECT * FROM inventory")
def _(spark, sf):
    path = work_path(spark, "names")
    files.export_csv(T.inventory(spark, sf).select(F.col("Date").alias("﻿Date"), F.col("Inventory_Level").alias(" Inventory_Level ")), path)
    return files.read_csv(spark, path, "inventory")


@query("io03_load_period", "Date:s Inventory_Level:d period:s", "SELECT * FROM inventory WHERE period = 'tune'")
def _(spark, sf):
    root = work_path(spark, "store")
    files.save_dataset(T.inventory(spark, sf), root, "inventory")
    assert files.load_dataset(spark, root, "outflows") is None
    return files.load_dataset(spark, root, "inventory", "tune")


@query("io04_saved_text", "Date:s period:s Inventory_Level:d", "SELECT * FROM inventory")
def _(spark, sf):
    root = work_path(spark, "text")
    files.save_dataset(T.inventory(spark, sf), root, "inventory", "parquet")
    return spark.read.parquet(f"{root}/inventory")


def _datasets(spark, sf):
    cols = [c for c in _FLOW if c != "Vendor"] + ["period"]
    return {"inventory": T.inventory(spark, sf), "inflows": T.inflows(spark, sf, ["Vendor", *cols]), "outflows": T.outflows(spark, sf, ["Partner", *cols])}


@query("io05_save_all", "period:s type:s saved:b", """SELECT p AS period, t AS type,
 (CASE t WHEN 'inventory' THEN (SELECT count(*) FROM inventory WHERE period = p) ELSE (SELECT count(*) FROM flows WHERE period = p AND flow = t) END) > 0 AS saved
 FROM unnest(['train', 'tune', 'test']) AS a(p), unnest(['inventory', 'inflows', 'outflows']) AS b(t)""")
def _(spark, sf):
    out = files.save_all(spark, _datasets(spark, sf), work_path(spark, "all"))
    return out.withColumn("saved", F.coalesce("saved", F.lit(False)))


@query("io06_catalog", "period:s type:s row_count:l sized:b", """SELECT period, 'inventory' AS type, count(*) AS row_count, true AS sized FROM inventory GROUP BY period
 UNION ALL SELECT period, flow, count(*), true FROM flows GROUP BY period, flow""")
def _(spark, sf):
    root = work_path(spark, "catalog")
    files.save_all(spark, _datasets(spark, sf), root)
    return files.catalog(spark, root).withColumn("sized", F.col("size_bytes") > 0)


@query("io07_combined_csv", "Dataset_Source:s Date:s Quantity:d Inventory_Level:d Vendor:s Partner:s", """
SELECT 'inventory' AS Dataset_Source, Date, NULL AS Quantity, Inventory_Level, NULL AS Vendor, NULL AS Partner FROM inventory
UNION ALL SELECT 'inflows', Date, Quantity, NULL, Vendor, NULL FROM inflows UNION ALL SELECT 'outflows', Date, Quantity, NULL, NULL, Partner FROM outflows""")
def _(spark, sf):
    path = work_path(spark, "combined")
    files.export_csv(files.combined(_datasets(spark, sf)), path)
    return files.read_csv(spark, path)


_SUMMARY = """SELECT 'inventory' AS dataset, count(*) AS rows, 3 AS columns, min(Date) || ' to ' || max(Date) AS date_range, 0 AS missing_values FROM inventory
 UNION ALL SELECT flow, count(*), 9, min(Date) || ' to ' || max(Date), 0 FROM flows GROUP BY flow"""


@query("io08_export_each", "dataset:s rows:l columns:l date_range:s missing_values:l", _SUMMARY)
def _(spark, sf):
    root = work_path(spark, "each")
    files.export_each(_datasets(spark, sf), root)
    return files.read_csv(spark, f"{root}/summary")


@query("io09_forecast_export", "Series:s model:s ds:s yhat:d yhat_lower:d yhat_upper:d RMSE:d MAE:d MAPE:d",
       f"WITH {FORECAST_SQL}\nFINAL SELECT f.*, rmse AS RMSE, mae AS MAE, mape AS MAPE FROM fc f LEFT JOIN mt USING (Series, model)", places=3)
def _(spark, sf):
    fc = simple_forecasts(spark, sf)
    path = work_path(spark, "forecasts")
    files.export_csv(files.forecasts_with_metrics(fc, E.accuracy(tune_levels(spark, sf), fc, ["Series"]), ["Series"]), path)
    return files.read_csv(spark, path)


@query("io10_profile_json", "section:s column:s total:d top:s", """SELECT 'descriptive_stats' AS section, 'Quantity' AS "column", CAST(count(Quantity) AS DOUBLE) AS total, NULL AS top FROM inflows
 UNION ALL SELECT 'missing_values', c, 0, NULL FROM unnest(['Date', 'Quantity', 'Brand']) AS u(c)
 UNION ALL SELECT 'date_range', 'Date', CAST(max(Date) - min(Date) AS DOUBLE), NULL FROM inflows
 UNION ALL SELECT 'categorical_distribution', 'Brand', max(n), arg_min(Brand, r) FROM (
 SELECT Brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, Brand) AS r FROM inflows GROUP BY 1)""")
def _(spark, sf):
    doc = files.profile_json(T.inflows(spark, sf, ["Date", "Quantity", "Brand"]), "inflows")
    number = lambda path: F.get_json_object("body", path).cast("double")
    total = (F.when(F.col("section") == "descriptive_stats", number("$.count")).when(F.col("section") == "date_range", number("$.total_days"))
             .when(F.col("section") == "missing_values", F.col("body").try_cast("double")).otherwise(number("$[0].n")))
    return doc.select("section", "column", total.alias("total"), F.get_json_object("body", "$[0].label").alias("top"))


@query("io11_export_metadata", "dataset:s rows:l columns:l date_range:s", _SUMMARY)
def _(spark, sf):
    meta = files.export_metadata(_datasets(spark, sf))
    parsed = F.from_json("metadata", "rows bigint, columns int, date_range string").alias("m")
    return meta.select("dataset", parsed).select("dataset", "m.*")


@query("io12_comparison_export", "Series:s model:s Date:s Actual:d Predicted:d Error:d Absolute_Error:d Percentage_Error:d", f"""
WITH {FORECAST_SQL}
FINAL SELECT Series, model, ds AS Date, round_even(y, 2) AS Actual, round_even(yhat, 2) AS Predicted, round_even(y - yhat, 2) AS Error,
 round_even(abs(y - yhat), 2) AS Absolute_Error, round_even((y - yhat) / CASE WHEN y <> 0 THEN y ELSE 1 END * 100, 2) AS Percentage_Error FROM fc JOIN tune_y USING (Series, ds)""", places=2)
def _(spark, sf):
    rows = E.compare(tune_levels(spark, sf), simple_forecasts(spark, sf), ["Series"])
    path = work_path(spark, "comparison")
    files.export_csv(files.comparison_rows(rows, ["Series", "model"]), path)
    return files.read_csv(spark, path)


@query("io13_export_bundle", "table:s rows:l", """SELECT 'inventory' AS "table", count(*) AS rows FROM inventory UNION ALL SELECT 'inflows', count(*) FROM inflows""")
def _(spark, sf):
    return files.export_bundle(_datasets(spark, sf), work_path(spark, "bundle"), ["inventory", "inflows", "absent"])
