"""The full analysis of one data set: trends, turnover, labels, patterns, change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.session import materialize

from . import aggregates as A
from . import drift as R
from . import series as S
from .frames import long_form

LABELS = ["Category", "Brand", "Warehouse", "Grade"]


def label_cube(flows: DataFrame) -> DataFrame:
    """Sums and counts of the shipments by flow and every label."""
    return flows.groupBy("flow", *LABELS).agg(
        F.sum("Quantity").alias("Quantity"), F.sum("Total_GIK").alias("Total_GIK"),
        F.count("Quantity").alias("shipments"), F.count(F.lit(1)).alias("rows"))


def analyze(inventory: DataFrame, flows: DataFrame, sample="period", first="train", second="tune") -> dict[str, DataFrame]:
    """One frame per section; `flows` carries flow, the labels, Quantity, Total_GIK.

    Levels are written once. The flows are read twice: into a written cube of their labels, from which all
    sums and counts come, and into the value counts behind the medians.
    """
    inventory, cube = materialize(inventory, "levels"), materialize(label_cube(flows), "labels")
    outflows = cube.where(F.col("flow") == "outflows")
    trends, turnover = S.level_trends(inventory), A.turnover(inventory, outflows, "span")
    labels = cube.select("flow", "rows", *LABELS).unpivot(["flow", "rows"], LABELS, "dimension", "label")
    return {
        "trends": trends,
        "turnover": turnover,
        "balance": A.flow_balance(cube),
        "labels": A.label_counts(labels, "label", ["flow", "dimension"], rows="rows"),
        "values": A.value_by(flows, "Category"),
        "patterns": A.level_patterns(inventory),
        "categories": A.flow_performance(cube, "Category", shipments="shipments"),
        "warehouses": A.flow_performance(cube, "Warehouse", shipments="shipments"),
        "change": R.period_comparison(inventory, "Inventory_Level", sample, first, second),
        "key_metrics": A.key_metrics(trends, turnover),
    }


def as_rows(sections: dict[str, DataFrame]) -> DataFrame:
    """The sections stacked as (section, subject, metric, value)."""
    subjects = {
        "labels": ["flow", "dimension", "label"], "values": ["Category"], "patterns": ["grain", "bucket"],
        "categories": ["Category"], "warehouses": ["Warehouse"]}
    out = None
    for name, df in sections.items():
        ids = subjects.get(name, [])
        numbers = [c for c, t in df.dtypes if c not in ids and t in ("double", "bigint", "int")]
        subject = F.concat_ws("|", *ids) if ids else F.lit("all")
        part = long_form(df.withColumn("subject", subject).withColumn("section", F.lit(name)), ["section", "subject"], numbers, "metric")
        out = part if out is None else out.unionByName(part)
    return out
