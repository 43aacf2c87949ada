"""The driver's tables seen as inventory, inflows and outflows.

Each builder takes the columns it must deliver, so a query that needs only
warehouses never joins parts or customers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TUNE_START, TEST_START = "1998-01-01", "2000-01-01"

_FROM_PART = {
    "Product_Type": "p_type", "Category": "p_type", "Brand": "p_brand",
    "Size": "p_size", "GIK_Per_Unit": "p_retailprice", "EI_Per_Unit": "p_retailprice",
}
_FROM_CUSTOMER = {"Partner": "c_name", "Program": "c_mktsegment"}
_FROM_ORDER = {"Date", "period", "Shipment_Type", *_FROM_CUSTOMER}
INFLOW_COLUMNS = [
    "Row_Id", "Date", "Vendor", "Quantity", "Product_Type", "Category", "Brand",
    "Grade", "Size", "Warehouse", "GIK_Per_Unit", "Total_GIK", "period",
]
OUTFLOW_COLUMNS = [
    "Row_Id", "Date", "Quantity", "Product_Type", "Category", "Brand", "Grade",
    "Size", "Warehouse", "GIK_Per_Unit", "Total_GIK", "Partner", "EI_Per_Unit",
    "Total_EI", "Shipment_Type", "Program", "period",
]


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; its schema is read from the files once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def period_of(date: Column) -> Column:
    return (
        F.when(date < F.lit(TUNE_START).cast("date"), "train")
        .when(date < F.lit(TEST_START).cast("date"), "tune")
        .otherwise("test")
    )


def _expressions(date_col: str) -> dict[str, Column]:
    paid_share = 1 - F.col("l_discount")
    date = F.col(date_col).cast("date")
    return {
        "Row_Id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "Date": date,
        "Vendor": F.col("s_name"),
        "Quantity": F.col("l_quantity"),
        "Product_Type": F.col("p_type"),
        "Category": F.col("p_type"),
        "Brand": F.col("p_brand"),
        "Grade": F.col("l_returnflag"),
        "Size": F.col("p_size").cast("string"),
        "Warehouse": F.col("n_name"),
        "GIK_Per_Unit": F.col("p_retailprice"),
        "Total_GIK": F.col("l_extendedprice"),
        "Partner": F.col("c_name"),
        "EI_Per_Unit": F.col("p_retailprice") * paid_share,
        "Total_EI": F.col("l_extendedprice") * paid_share,
        "Shipment_Type": F.col("o_orderpriority"),
        "Program": F.col("c_mktsegment"),
        "period": period_of(date),
    }


def _flows(spark, sf_dir, status, date_col, columns):
    wanted = set(columns)
    df = table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == status)
    if wanted & set(_FROM_PART):
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if wanted & {"Vendor", "Warehouse"}:
        df = df.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    if "Warehouse" in wanted:
        df = df.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    if date_col == "o_orderdate" and wanted & _FROM_ORDER:
        df = df.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if wanted & set(_FROM_CUSTOMER):
        df = df.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    exprs = _expressions(date_col)
    return df.select(*[exprs[c].alias(c) for c in columns])


def inflows(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return _flows(spark, sf_dir, "O", "l_shipdate", columns or INFLOW_COLUMNS)


def outflows(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return _flows(spark, sf_dir, "F", "o_orderdate", columns or OUTFLOW_COLUMNS)


def inventory(spark: SparkSession, sf_dir: str, by_priority: bool = False) -> DataFrame:
    """Daily level; with `by_priority` one series per order priority."""
    keys = [F.col("o_orderpriority").alias("Series")] if by_priority else []
    date = F.col("o_orderdate").cast("date")
    level = F.round(F.sum("o_totalprice"), 2).alias("Inventory_Level")
    daily = table(spark, sf_dir, "orders").groupBy(*keys, date.alias("Date")).agg(level)
    return daily.withColumn("period", period_of(F.col("Date")))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several level readings per day, with the order in which they arrived."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("Series"),
        F.col("o_orderdate").cast("date").alias("Date"),
        F.col("o_totalprice").alias("Inventory_Level"),
        F.col("o_orderkey").alias("seq"),
    )


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same readings as untyped text with bad dates and bad numbers."""
    orders = table(spark, sf_dir, "orders")
    bad_date = F.col("o_orderstatus") == "P"
    bad_level = F.col("o_orderpriority") == "5-LOW"
    return orders.select(
        F.when(bad_date, "unknown").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("Date"),
        F.when(bad_level, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("Inventory_Level"),
        F.col("o_orderkey").alias("seq"),
    )


def flow_datasets(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Inflows and outflows stacked, tagged with their origin."""
    return inflows(spark, sf_dir, columns).withColumn("flow", F.lit("inflows")).unionByName(
        outflows(spark, sf_dir, columns).withColumn("flow", F.lit("outflows"))
    )
