"""Grouped summaries of stock levels and flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import attach, has, known, over, ratio, with_totals
from .ranks import counted, cumulative, moments_of, quantiles_of, shape_columns, value_counts

PERCENTILES = {"p5": 0.05, "p10": 0.10, "q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def daily_features(inflows: DataFrame, outflows: DataFrame | None, dim: str, names: dict[str, str]) -> DataFrame:
    """Per day: total in, total out, active members of `dim` and their diversity.

    `names` maps in/out/active/diversity/simpson to output columns. Both flows
    are stacked and summed by (Date, dim) in one aggregation, which stands for
    the two grouped sums joined in full with missing sides as zero.
    """
    zero = F.lit(0.0)
    tagged = inflows.select("Date", dim, F.col("Quantity").alias("q_in"), zero.alias("q_out"))
    if outflows is not None and has(outflows, dim):
        tagged = tagged.unionByName(outflows.select("Date", dim, zero.alias("q_in"), F.col("Quantity").alias("q_out")))
    by_member = known(tagged, ["Date", dim]).groupBy("Date", dim).agg(
        F.coalesce(F.sum("q_in"), zero).alias("q_in"), F.coalesce(F.sum("q_out"), zero).alias("q_out")
    )
    moved = F.col("q_in") + F.col("q_out")
    members = F.count(F.lit(1))
    return by_member.groupBy("Date").agg(
        F.sum("q_in").alias(names["in"]),
        F.sum("q_out").alias(names["out"]),
        members.alias(names["active"]),
        # Each member counts once a day, so the concentration is 1 / members.
        (1 - F.try_divide(F.lit(1.0), members.cast("double"))).alias(names["diversity"]),
        (1 - ratio(F.sum(moved * moved), F.sum(moved) * F.sum(moved), 1.0)).alias(names["simpson"]),
    )


# Output names of the two feature sets.
WAREHOUSE_NAMES = {
    "in": "Total_Daily_Inflows", "out": "Total_Daily_Outflows", "active": "Active_Warehouses",
    "diversity": "Warehouse_Diversity", "simpson": "Warehouse_Simpson",
}
CATEGORY_NAMES = {
    "in": "Total_Category_Inflows", "out": "Total_Category_Outflows", "active": "Active_Categories",
    "diversity": "Category_Diversity", "simpson": "Category_Simpson",
}


def warehouse_features(inflows, outflows=None) -> DataFrame:
    return daily_features(inflows, outflows, "Warehouse", WAREHOUSE_NAMES)


def category_features(inflows, outflows=None) -> DataFrame:
    return daily_features(inflows, outflows, "Category", CATEGORY_NAMES)


def distribution(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Full distribution profile with exact percentiles, one row per key."""
    counts = counted(df, value, keys)
    base = moments_of(counts, value, keys).select(*keys, *shape_columns())
    return attach(base, quantiles_of(counts, value, PERCENTILES, keys), keys).withColumn("iqr", F.col("q3") - F.col("q1"))


def label_counts(df: DataFrame, label: str, keys: Sequence[str] = (), rows: str | None = None) -> DataFrame:
    """Occurrences and share of every label; `rows` weighs rows that stand for several."""
    group = [*keys, label]
    counts = known(df, group).groupBy(*group).agg(F.sum(rows).alias("n")) if rows else value_counts(df, label, keys)
    return with_totals(counts, keys, _all=F.sum("n")).withColumn("share", ratio("n", "_all")).drop("_all")


def top_labels(counts: DataFrame, label: str, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """The k most frequent labels per key; ties go to the smaller label."""
    order = [F.desc("n"), F.asc(label)]
    if not keys:
        return counts.orderBy(*order).limit(k)
    return counts.withColumn("_r", F.row_number().over(over(keys, *order))).where(F.col("_r") <= k).drop("_r")


def value_by(df: DataFrame, dim: str, value: str = "Total_GIK") -> DataFrame:
    """Mean, median and total of a value per label."""
    counts = counted(df, value, [dim])
    total, n = F.sum(F.col(value).cast("double") * F.col("n")), F.sum("n")
    base = counts.groupBy(dim).agg((total / n).alias("mean"), total.alias("total"), n.alias("n"))
    return attach(base, quantiles_of(counts, value, {"median": 0.5}, [dim]), [dim])


def flow_performance(flows: DataFrame, dim: str, shipments: str | None = None) -> DataFrame:
    """Per label: quantity and value of both flows and the net flow.

    `flows` carries a `flow` tag, so one pass serves both sides; `shipments` is the count behind each row
    when `flows` are sums.
    """
    cols = []
    for flow, tag in (("inflows", "in"), ("outflows", "out")):
        here = F.col("flow") == flow
        q = F.when(here, F.col("Quantity"))
        n = F.coalesce(F.sum(F.when(here, F.col(shipments))), F.lit(0)) if shipments else F.count(q)
        cols += [
            F.coalesce(F.sum(q), F.lit(0.0)).alias(f"{tag}_sum"),
            (ratio(F.sum(q), n) if shipments else F.avg(q)).alias(f"{tag}_mean"),
            n.alias(f"{tag}_count"),
        ]
        if has(flows, "Total_GIK"):
            cols.append(F.coalesce(F.sum(F.when(here, F.col("Total_GIK"))), F.lit(0.0)).alias(f"{tag}_value"))
    return known(flows, [dim]).groupBy(dim).agg(*cols).withColumn("net_flow", F.col("in_sum") - F.col("out_sum"))


def by_grain(df: DataFrame, grains: dict[str, Column], aggs: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """One scan, several calendar grains: GROUPING SETS over the grain columns; undated rows belong to none."""
    tagged = df.select(*keys, *[c.alias(g) for g, c in grains.items()], *[c for c in df.columns if c not in keys])
    tagged = known(tagged, grains)
    sets = [[*keys, g] for g in grains]
    out = tagged.groupingSets([[F.col(c) for c in s] for s in sets], *keys, *grains).agg(*aggs)
    # Exactly one grain column is set in every row of its own set.
    grain = F.coalesce(*[F.when(F.col(g).isNotNull(), F.lit(g)) for g in grains])
    bucket = F.coalesce(*[F.col(g).cast("string") for g in grains])
    rest = [c for c in out.columns if c not in grains and c not in keys]
    return out.select(*keys, grain.alias("grain"), bucket.alias("bucket"), *rest)


def level_patterns(inventory: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    d = F.col("Date")
    grains = {
        "month": F.month(d), "quarter": F.quarter(d),
        "weekday": F.date_format(d, "EEEE"), "year": F.year(d),
    }
    return by_grain(inventory, grains, [F.avg("Inventory_Level").alias("mean_level")], keys)


def flow_patterns(flows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    d = F.col("Date")
    return by_grain(flows, {"month": F.month(d), "quarter": F.quarter(d)}, [F.sum("Quantity").alias("total")], keys)


# Turnover bands, strictly above the bound.
TURNOVER_BANDS = [
    (12, "Very high turnover - inventory moves quickly"),
    (6, "High turnover - efficient inventory management"),
    (3, "Moderate turnover - reasonable efficiency"),
    (1, "Low turnover - inventory may be excessive"),
]
TURNOVER_REST = "Very low turnover - significant inventory accumulation"


def turnover_label(turnover: Column) -> Column:
    label = F.lit(TURNOVER_REST)
    for bound, text in reversed(TURNOVER_BANDS):
        label = F.when(turnover > bound, text).otherwise(label)
    return label


def turnover(inventory: DataFrame, outflows: DataFrame, basis: str = "span") -> DataFrame:
    """Outflow relative to the mean level.

    basis: "raw" as is, "rows" annualised by the number of level rows, "span"
    annualised by the days between first and last level.
    """
    stock = inventory.agg(
        F.avg("Inventory_Level").alias("avg_inventory"),
        F.count(F.lit(1)).cast("double").alias("_rows"),
        F.datediff(F.max("Date"), F.min("Date")).cast("double").alias("_span"),
    )
    out = attach(outflows.agg(F.coalesce(F.sum("Quantity"), F.lit(0.0)).alias("total_outflows")), stock)
    days = {"raw": None, "rows": F.col("_rows"), "span": F.when(F.col("_span") > 0, F.col("_span"))}[basis]
    yearly = F.lit(1.0) if days is None else ratio(F.lit(365.0), days, 1.0)
    horizon = F.col("_span") if basis == "raw" else F.lit(365.0)
    idle = F.col("_span") if basis == "raw" else F.lit(None).cast("double")
    rate = F.when(F.col("avg_inventory") > 0, F.col("total_outflows") * yearly / F.col("avg_inventory")).otherwise(0.0)
    out = out.withColumn("turnover", rate)
    return out.select(
        F.lit(basis).alias("basis"), "avg_inventory", "total_outflows", "turnover",
        F.when(F.col("turnover") > 0, ratio(horizon, F.col("turnover"))).otherwise(idle).alias("days_of_stock"),
        turnover_label(F.col("turnover")).alias("label"),
    )


def flow_balance(flows: DataFrame) -> DataFrame:
    total = lambda f: F.coalesce(F.sum(F.when(F.col("flow") == f, F.col("Quantity"))), F.lit(0.0))
    return flows.agg(total("inflows").alias("total_inflows"), total("outflows").alias("total_outflows")).select(
        "*",
        (F.col("total_inflows") - F.col("total_outflows")).alias("net_change"),
        F.when(F.col("total_outflows") > 0, ratio("total_inflows", "total_outflows")).alias("flow_ratio"),
    )


def monthly_flows(flows: DataFrame) -> DataFrame:
    month = F.date_format(F.trunc("Date", "month"), "yyyy-MM").alias("month")
    side = lambda f: F.sum(F.when(F.col("flow") == f, F.col("Quantity")))
    return flows.groupBy(month).agg(side("inflows").alias("inflow"), side("outflows").alias("outflow"))


def partner_volumes(outflows: DataFrame) -> DataFrame:
    """Shipments per partner with the volume rank; equal volumes share a rank.

    The volumes are written once, so that both sides of the join hold the same sums. The rank comes from cumulative counts over distinct volumes, so no task
    sorts all partners.
    """
    from stocktide.session import materialize

    per = known(outflows, ["Partner"]).groupBy("Partner").agg(
        F.sum("Quantity").alias("total_quantity"),
        F.count("Quantity").alias("shipment_count"),
        F.avg("Quantity").alias("avg_shipment"),
    )
    per = materialize(per, "partners")
    above = cumulative(
        materialize(per.groupBy((-F.col("total_quantity")).alias("_neg")).agg(F.count(F.lit(1)).alias("n")), "volumes"), "_neg", ["n"]
    )
    ranked = per.join(
        above.select((-F.col("_neg")).alias("total_quantity"), (F.col("cum_n") - F.col("n")).alias("_above")),
        "total_quantity",
    )
    return ranked.select(*per.columns, (F.col("_above") + 1).alias("rank"))


def partner_overview(outflows: DataFrame) -> DataFrame:
    return outflows.agg(
        F.countDistinct("Partner").alias("partners"), F.count(F.lit(1)).alias("shipments"),
        F.sum("Quantity").alias("total_quantity"), F.avg("Quantity").alias("avg_shipment"),
    )


def partner_trend(outflows: DataFrame, partner: str | None = None, grain: str = "month") -> DataFrame:
    if partner is not None:
        outflows = outflows.where(F.col("Partner") == partner)
    bucket = F.date_format("Date", "yyyy-MM" if grain == "month" else "yyyy-MM-dd").alias("bucket")
    return outflows.groupBy(bucket).agg(F.sum("Quantity").alias("quantity"))


def partner_comparison(outflows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Monthly quantity of the partners listed in `chosen` (a column Partner)."""
    kept = outflows.join(chosen.select("Partner"), "Partner", "left_semi")
    return kept.groupBy(F.date_format("Date", "yyyy-MM").alias("month"), "Partner").agg(
        F.sum("Quantity").alias("quantity")
    )


def partner_metrics(outflows: DataFrame) -> DataFrame:
    extra = [F.sum(c).alias(c.lower()) for c in ("Total_GIK", "Total_EI") if has(outflows, c)]
    return known(outflows, ["Partner"]).groupBy("Partner").agg(
        F.count(F.lit(1)).alias("shipments"), F.sum("Quantity").alias("quantity"),
        F.avg("Quantity").alias("avg_size"), *extra,
    )


def period_summary(inventory: DataFrame, flows: DataFrame) -> DataFrame:
    """Rows and headline numbers per dataset type and period."""
    nil = F.lit(None).cast("double")
    stock = inventory.groupBy("period").agg(
        F.count(F.lit(1)).alias("records"), F.avg("Inventory_Level").alias("avg"),
        F.min("Inventory_Level").alias("min"), F.max("Inventory_Level").alias("max"),
    ).select(F.lit("inventory").alias("type"), "*", nil.alias("total"), nil.alias("total_gik"))
    moved = flows.groupBy(F.col("flow").alias("type"), "period").agg(
        F.count(F.lit(1)).alias("records"), F.avg("Quantity").alias("avg"),
        F.sum("Quantity").alias("total"),
        (F.sum("Total_GIK") if has(flows, "Total_GIK") else nil).alias("total_gik"),
    )
    return stock.unionByName(moved, allowMissingColumns=True)


def performance(inventory: DataFrame, inflows: DataFrame) -> DataFrame:
    level = inventory.agg(
        F.avg("Inventory_Level").alias("average_level"), F.max("Inventory_Level").alias("peak_level"),
        F.min("Inventory_Level").alias("minimum_level"),
        ratio(F.stddev("Inventory_Level"), F.avg("Inventory_Level"), 0.0).alias("variation"),
    )
    gifts = inflows.agg(
        F.sum("Quantity").alias("total_volume"), F.avg("Quantity").alias("average_size"),
        F.count(F.lit(1)).alias("donations"),
    )
    return attach(level, gifts)


def baseline(inventory: DataFrame) -> DataFrame:
    """Level statistics over all given periods with the population deviation."""
    v = "Inventory_Level"
    counts = counted(inventory, v)
    spread = F.sqrt(F.col("m2") / F.col("count"))
    found = moments_of(counts, v).select(F.col("mean").alias("average"), spread.alias("std"), "min", "max")
    return attach(found, quantiles_of(counts, v, {"median": 0.5}))


def category_insights(inflows: DataFrame, recent="tune", earlier="train") -> DataFrame:
    """Value and volume per category in two periods, growth and leading brands."""
    rows = known(inflows, ["Category"])
    at = lambda p, c: F.when(F.col("period") == p, c)
    cols = []
    for p in (recent, earlier):
        cols += [
            F.sum(at(p, F.col("Total_GIK"))).alias(f"{p}_value"),
            F.avg(at(p, F.col("Total_GIK"))).alias(f"{p}_avg"),
            F.count(at(p, F.col("Total_GIK"))).alias(f"{p}_volume"),
        ]
    per = rows.where(F.col("period").isin(recent, earlier)).groupBy("Category").agg(*cols)
    brands = top_labels(
        value_counts(rows.where(F.col("period") == recent), "Brand", ["Category"]), "Brand", 3, ["Category"]
    ).groupBy("Category").agg(
        F.concat_ws(
            ",", F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "Brand"))), lambda s: s["Brand"])
        ).alias("top_brands")
    )
    change = lambda m: F.when(
        (F.col(f"{recent}_{m}") > 0) & (F.col(f"{earlier}_{m}") > 0),
        ratio(F.col(f"{recent}_{m}") - F.col(f"{earlier}_{m}"), F.col(f"{earlier}_{m}")) * 100,
    )
    return per.join(brands, "Category", "left").select(
        "*", change("volume").alias("volume_growth"), change("avg").alias("value_growth")
    )


def dominant_label(df: DataFrame, label: str, rows: str | None = None) -> DataFrame:
    """The most frequent label and its share in percent; `rows` weighs rows that stand for several."""
    counts = known(df, [label]).groupBy(label).agg(F.sum(rows).alias("n")) if rows else value_counts(df, label)
    return counts.agg(
        F.max_by(label, F.struct("n", label)).alias(label),
        (F.max("n") * 100.0 / F.sum("n")).alias("percentage"),
    )


def distinct_labels(flows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Every value of each dimension, as (dimension, value)."""
    return flows.select(*dims).unpivot([], list(dims), "dimension", "value").na.drop(subset=["value"]).distinct()


def histogram(df: DataFrame, value: str, bins: int, lo: Column, hi: Column) -> DataFrame:
    """Equal-width bins; the maximum belongs to the last one."""
    width = (hi - lo) / bins
    at = F.floor(ratio(F.col(value) - lo, width, 0.0))
    return known(df, [value]).groupBy(F.least(at, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def key_metrics(trends: DataFrame, turnover_row: DataFrame) -> DataFrame:
    picked = trends.select(
        F.col("mean_level").alias("avg_inventory"), F.col("max_level").alias("peak_inventory"),
        F.col("min_level").alias("min_inventory"), F.col("daily_volatility").alias("inventory_volatility"),
    )
    return attach(picked, turnover_row.select(F.col("turnover").alias("turnover_rate"), "days_of_stock"))
