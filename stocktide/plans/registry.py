"""Registration of queries with an output shape and an optional SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.sources.tables import TEST_START, TUNE_START

_SPARK_TYPE = {"s": "string", "d": "double", "l": "bigint", "b": "boolean"}
_DUCK_TYPE = {"s": "VARCHAR", "d": "DOUBLE", "l": "BIGINT", "b": "BOOLEAN"}

# Published doubles are rounded; this share of the last place moves exact halves
# (common in means and interpolations) off the boundary where engines differ.
_NUDGE = 0.0137

_PERIOD = (
    f"CASE WHEN {{d}} < DATE '{TUNE_START}' THEN 'train' "
    f"WHEN {{d}} < DATE '{TEST_START}' THEN 'tune' ELSE 'test' END AS period"
)
PRELUDE = f"""
WITH RECURSIVE star AS (
  SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS Row_Id
  FROM lineitem JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), inflows AS (
  SELECT Row_Id, CAST(l_shipdate AS DATE) AS Date, s_name AS Vendor, l_quantity AS Quantity,
         p_type AS Product_Type, p_type AS Category, p_brand AS Brand, l_returnflag AS Grade,
         CAST(p_size AS VARCHAR) AS Size, n_name AS Warehouse, p_retailprice AS GIK_Per_Unit,
         l_extendedprice AS Total_GIK, {_PERIOD.format(d="CAST(l_shipdate AS DATE)")}
  FROM star WHERE l_linestatus = 'O'
), outflows AS (
  SELECT Row_Id, CAST(o_orderdate AS DATE) AS Date, l_quantity AS Quantity, p_type AS Product_Type,
         p_type AS Category, p_brand AS Brand, l_returnflag AS Grade, CAST(p_size AS VARCHAR) AS Size,
         n_name AS Warehouse, p_retailprice AS GIK_Per_Unit, l_extendedprice AS Total_GIK,
         c_name AS Partner, p_retailprice * (1 - l_discount) AS EI_Per_Unit,
         l_extendedprice * (1 - l_discount) AS Total_EI, o_orderpriority AS Shipment_Type,
         c_mktsegment AS Program, {_PERIOD.format(d="CAST(o_orderdate AS DATE)")}
  FROM star JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE l_linestatus = 'F'
), inventory AS (
  SELECT *, {_PERIOD.format(d="Date")} FROM (
    SELECT CAST(o_orderdate AS DATE) AS Date, round(sum(o_totalprice), 2) AS Inventory_Level
    FROM orders GROUP BY 1)
), stock AS (
  SELECT *, {_PERIOD.format(d="Date")} FROM (
    SELECT o_orderpriority AS Series, CAST(o_orderdate AS DATE) AS Date,
           round(sum(o_totalprice), 2) AS Inventory_Level
    FROM orders GROUP BY 1, 2)
), snapshots AS (
  SELECT o_orderpriority AS Series, CAST(o_orderdate AS DATE) AS Date,
         o_totalprice AS Inventory_Level, o_orderkey AS seq FROM orders
), readings AS (
  SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS Date,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS Inventory_Level,
         o_orderkey AS seq FROM orders
), flows AS (
  SELECT 'inflows' AS flow, Row_Id, Date, Quantity, Product_Type, Category, Brand, Grade, Size,
         Warehouse, GIK_Per_Unit, Total_GIK, period FROM inflows
  UNION ALL
  SELECT 'outflows', Row_Id, Date, Quantity, Product_Type, Category, Brand, Grade, Size,
         Warehouse, GIK_Per_Unit, Total_GIK, period FROM outflows
)"""


@dataclass(frozen=True)
class Entry:
    build: Callable
    shape: list[tuple[str, str]]
    sql: str | None
    places: int


ENTRIES: dict[str, Entry] = {}


def query(name: str, out: str, sql: str | None = None, places: int = 4):
    """Register `build(spark, sf_dir)`.

    `out` lists `column:type` with s string (dates are published as text),
    d double (rounded to `places` on both sides), l long and b boolean.
    """
    shape = [tuple(item.split(":")) for item in out.split()]

    def register(build):
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(build, shape, sql, places)
        return build

    return register


def published(df: DataFrame, entry: Entry) -> DataFrame:
    cols = []
    for column, kind in entry.shape:
        c = F.col(column).cast(_SPARK_TYPE[kind])
        if kind == "d":
            c = F.round(c + F.lit(_NUDGE / 10**entry.places), entry.places) + F.lit(0.0)
        cols.append(c.alias(column))
    return df.select(*cols)


def oracle_text(entry: Entry) -> str:
    cols = []
    for column, kind in entry.shape:
        c = f'CAST("{column}" AS {_DUCK_TYPE[kind]})'
        if kind == "d":
            c = f"round({c} + {_NUDGE / 10**entry.places!r}, {entry.places}) + 0e0"
        cols.append(f'{c} AS "{column}"')
    body = entry.sql.strip()
    extra = ""
    if body[:5].upper() == "WITH ":
        # The caller's own CTEs continue the shared list.
        head, tail = body[5:].split("\nFINAL ", 1)
        extra, body = ", " + head, tail
    return f"{PRELUDE}{extra}\nSELECT {', '.join(cols)} FROM ({body}) AS result"
