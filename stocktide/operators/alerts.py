"""Risk alerts, recommendations, forecast alerts and combined insight runs.

Results are rows with the rule, its level and the numbers behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.session import materialize

from . import aggregates as A
from . import policy as P
from . import series as S
from .clean import selected
from .frames import attach, long_form, ratio


def _recent_against_before(flows: DataFrame, shipments, days: int = 30) -> DataFrame:
    """Mean quantity of a shipment in the last days and in the time before, per flow."""
    end = flows.groupBy("flow").agg(F.date_sub(F.max("Date"), days).alias("_from"))
    rows = attach(flows, end, ["flow"])
    recent = F.col("Date") >= F.col("_from")
    mean = lambda when: ratio(F.sum(F.when(when, F.col("Quantity"))), F.sum(F.when(when, shipments)))
    return rows.groupBy("flow").agg(mean(recent).alias("recent"), mean(~recent).alias("before"))


def fired(facts: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """One row per rule that holds. A rule is (name, level, condition, value, reference)."""
    number = lambda c: (F.lit(c) if not hasattr(c, "cast") else c).cast("double")
    rows = [
        F.struct(F.lit(n).alias("type"), F.lit(lv).alias("severity") if isinstance(lv, str) else lv.alias("severity"),
                 F.coalesce(cond, F.lit(False)).alias("_on"), number(v).alias("value"), number(r).alias("reference"))
        for n, lv, cond, v, r in rules]
    return facts.select(F.inline(F.array(*rows))).where(F.col("_on")).drop("_on")


def level_and_flow_risks(inventory: DataFrame, flows: DataFrame, forecasts: DataFrame | None = None, shipments=None) -> DataFrame:
    """Low level, falling inflow, rising outflow and a low forecast.

    `shipments` is the count behind each row when `flows` are daily sums.
    """
    moved = _recent_against_before(flows, F.when(F.col("Quantity").isNotNull(), 1) if shipments is None else shipments)
    at = lambda f, c: F.max(F.when(F.col("flow") == f, F.col(c)))
    wide = moved.agg(*[at(f"{t}flows", c).alias(f"{t}_{c}") for t in ("in", "out") for c in ("recent", "before")])
    facts = attach(P.current_level(inventory), wide)
    rules = [
        ("LOW_INVENTORY", "HIGH", F.col("current_level") < F.col("average_level") * 0.5, F.col("current_level"), F.col("average_level")),
        ("DECLINING_INFLOWS", "MEDIUM", F.col("in_recent") < F.col("in_before") * 0.7, F.col("in_recent"), F.col("in_before")),
        ("INCREASING_DEMAND", "MEDIUM", F.col("out_recent") > F.col("out_before") * 1.3, F.col("out_recent"), F.col("out_before")),
    ]
    if forecasts is not None:
        facts = attach(facts, forecasts.agg(F.min("yhat").alias("_low")))
        rules.append(("FORECAST_LOW_INVENTORY", "HIGH", F.col("_low") < F.col("current_level") * 0.3, F.col("_low"), F.col("current_level")))
    return fired(facts, rules)


def operational_risks(outliers: DataFrame, drift_summary: DataFrame, inventory: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Extreme values, drift, volatility, forecast uncertainty and rapid growth."""
    v = "Inventory_Level"
    facts = attach(inventory.agg(ratio(F.stddev(v), F.avg(v), 0.0).alias("cv")),
                   outliers.agg(F.count_if((F.col("column") == "Total_GIK") & (F.col("value") > 1e6)).alias("extreme")))
    facts = attach(facts, drift_summary.select("drift_severity"))
    growth = S.growth_between_ends(inventory, [], "Date", v).agg(F.max("growth").alias("growth"))
    facts = attach(facts, growth)
    rules = [
        ("EXTREME_VALUES", "high", F.col("extreme") > 0, F.col("extreme"), 1e6),
        ("DATA_DRIFT", F.lower("drift_severity"), F.col("drift_severity").isin("High", "Medium"), 0.0, 0.0),
        ("INVENTORY_VOLATILITY", "medium", F.col("cv") > 0.3, F.col("cv"), 0.3),
        ("CAPACITY", "medium", F.col("growth") > 0.5, F.col("growth") * 100, 50.0),
    ]
    if metrics is not None:
        facts = attach(facts, metrics.agg(F.max("mape").alias("worst_mape")))
        rules.append(("FORECAST_UNCERTAINTY", "medium", F.col("worst_mape") > 30, F.col("worst_mape"), 30.0))
    return fired(facts, rules)


# Titles, priority and impact of the recommendations.
RECOMMENDATIONS = {
    "quality": ("Improve Data Quality and Governance", "High", "High"),
    "scale": ("Adapt Inventory Management for Scale Changes", "High", "High"),
    "ensemble": ("Implement Ensemble Forecasting", "Medium", "Medium"),
    "diversify": ("Diversify Product Category Portfolio", "Medium", "Medium"),
    "seasonal": ("Implement Seasonal Inventory Planning", "Medium", "High"),
}


def recommendations(outliers: DataFrame, shifts: DataFrame, models: DataFrame, inflows: DataFrame, rows: str | None = None) -> DataFrame:
    """Recommendations whose rule holds; seasonal planning always does. `rows` counts the shipments behind a row of `inflows`."""
    facts = attach(outliers.agg(F.count(F.lit(1)).alias("outliers")),
                   shifts.agg(F.coalesce(F.max(F.abs(1 - F.col("ratio"))), F.lit(0.0)).alias("shift")))
    has_model = lambda m: F.coalesce(F.bool_or(F.col("model") == m), F.lit(False))
    facts = attach(facts, models.agg((has_model("Prophet") & has_model("SARIMA")).alias("both")))
    facts = attach(facts, A.dominant_label(inflows, "Category", rows).select(F.col("percentage").alias("share")))
    holds = {"quality": F.col("outliers") > 50, "scale": F.col("shift") > 0.3, "ensemble": F.col("both"),
             "diversify": F.col("share") > 60, "seasonal": F.lit(True)}
    rows = [F.struct(F.lit(t).alias("title"), F.lit(p).alias("priority"), F.lit(i).alias("impact"),
                     F.coalesce(holds[k], F.lit(False)).alias("_on")) for k, (t, p, i) in RECOMMENDATIONS.items()]
    return facts.select(F.inline(F.array(*rows))).where(F.col("_on")).drop("_on")


def forecast_alerts(forecasts: DataFrame, baseline: DataFrame, as_of, keys: Sequence[str] = (), low=0.15, critical=0.05, high=2.5, window=14) -> DataFrame:
    """Forecast days within the window whose level leaves the safe range.

    `baseline` holds `average`, overall or per key. kind is critical, stockout
    or overstock.
    """
    rows = attach(forecasts, baseline.select(*keys, F.col("average").alias("_avg")), keys)
    days = F.datediff("ds", as_of if hasattr(as_of, "cast") else F.lit(as_of).cast("date"))
    y, avg = F.col("yhat"), F.col("_avg")
    kind = F.when(y < avg * critical, "critical").when(y < avg * low, "stockout").when(y > avg * high, "overstock")
    out = rows.withColumn("days_until", days).withColumn("kind", kind)
    out = out.where(F.col("kind").isNotNull() & F.col("days_until").between(0, window))
    limit = F.when(F.col("kind") == "overstock", avg * high).otherwise(avg * low)
    return out.select(*keys, "model", F.date_format("ds", "yyyy-MM-dd").alias("date"), F.bround("yhat", 0).alias("predicted_level"),
                      F.bround(limit, 0).alias("threshold"), F.when(F.col("kind") == "critical", "critical").otherwise("warning").alias("severity"),
                      "days_until", "kind")


def alert_summary(alerts: DataFrame) -> DataFrame:
    count = lambda k: F.count_if(F.col("kind") == k)
    return alerts.agg(count("stockout").alias("stockout_alerts"), count("critical").alias("critical_alerts"), count("overstock").alias("overstock_alerts"))


def alert_advice(counts: DataFrame) -> DataFrame:
    """Advice codes implied by the alert counts; `stable` when none applies."""
    s, c, o = F.col("stockout_alerts"), F.col("critical_alerts"), F.col("overstock_alerts")
    found = F.array_compact(F.array(
        F.when(c > 0, "expedite_procurement"), F.when(s > 3, "raise_safety_stock"), F.when(o > 3, "reduce_excess"),
        F.when((s > 0) & (o > 0), "dynamic_reorder_policy")))
    return counts.select(F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("stable")))).alias("advice"))


def insight_run(inventory: DataFrame, flows: DataFrame, forecasts: DataFrame | None = None, metrics: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """All operational insights as rows (section, subject, value).

    The flows are read once, into a written cube of daily sums that every part is derived from.
    """
    from stocktide.models.simple import demand_outlook

    flows = materialize(P.daily_cube(flows), "cube")
    outflows, inflows = flows.where(F.col("flow") == "outflows"), flows.where(F.col("flow") == "inflows")
    row = lambda df, section, subject, value: df.select(
        F.lit(section).alias("section"), subject.cast("string").alias("subject"), value.cast("double").alias("value"))
    cell = F.concat_ws("|", "Category", "Warehouse")
    parts = [
        row(P.reorder_by_cell(outflows, inventory), "reorder_point", cell, F.col("reorder_point")),
        row(P.safety_by_cell(outflows), "safety_stock", cell, F.col("safety_stock")),
        row(level_and_flow_risks(inventory, flows, forecasts, F.col("shipments")), "risk", F.col("type"), F.col("value")),
        row(P.category_trends(inflows, middle=P.middle_day(inflows)), "category_trend", F.concat_ws("|", "kind", "Category"), F.col("growth")),
        row(P.warehouse_efficiency(flows), "warehouse_score", F.col("Warehouse"), F.col("score")),
        row(demand_outlook(outflows), "demand", F.col("Category"), F.col("forecast")),
        row(P.opportunities(None, inventory, P.category_spread(outflows)), "opportunity", F.concat_ws("|", "type", "category"), F.col("value")),
    ]
    if metrics is not None:
        parts.append(row(P.safety_by_model(metrics, keys), "model_safety_stock", F.concat_ws("|", *keys, "model", "service_level"), F.col("safety_stock")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def live_run(inventory: DataFrame, flows: DataFrame, found: dict[str, DataFrame], models: DataFrame, metrics: DataFrame, keys: Sequence[str] = (),
             recent: str = "tune", earlier: str = "train", warehouses=None, categories=None) -> DataFrame:
    """Recommendations, risk alerts, optimisation, category insights and performance as rows (section, subject, value).

    `found` is a detection run, which chosen warehouses and categories leave as it is. The flows are read
    once into a written cube; the choice applies to its cells and everything from the flows is worked out after it.
    """
    cube = selected(materialize(P.dimension_cube(flows), "dimension_cube"), Warehouse=warehouses, Category=categories)
    inflows, outflows = cube.where("flow = 'inflows'"), cube.where((F.col("flow") == "outflows") & (F.col("period") == recent))
    level = inventory.where(F.col("period") == recent)
    at = lambda p, c: F.sum(F.when(F.col("period") == p, F.col(c)))
    row = lambda df, section, subject, value: df.select(
        F.lit(section).alias("section"), subject.cast("string").alias("subject"), value.cast("double").alias("value"))

    advice = recommendations(found["outliers"], found["shifts"], models, inflows.where(F.col("period") == recent), "rows")
    risks = operational_risks(found["outliers"], found["summary"], level, metrics)
    per = P.merged_moments(outflows.where(F.col("Category").isNotNull()), ["Category"])
    mean, spread = F.col("total") / F.col("count"), F.when(F.col("count") > 1, F.sqrt(F.col("m2") / (F.col("count") - 1)))
    stock = P.safety_by_model(metrics, keys)
    turn = A.turnover(level, outflows, "rows")

    both = inflows.where(F.col("Category").isNotNull() & F.col("period").isin(recent, earlier))
    named = {f"{p}_{n}": at(p, c) for p in (recent, earlier) for n, c in (("value", "Total_GIK"), ("volume", "valued"))}
    sums = both.groupBy("Category").agg(*[c.alias(n) for n, c in named.items()])
    sums = sums.withColumns({f"{p}_avg": ratio(f"{p}_value", f"{p}_volume") for p in (recent, earlier)})
    change = lambda m: F.when((F.col(f"{recent}_{m}") > 0) & (F.col(f"{earlier}_{m}") > 0), ratio(F.col(f"{recent}_{m}") - F.col(f"{earlier}_{m}"), F.col(f"{earlier}_{m}")) * 100)
    sums = sums.withColumns({"volume_growth": change("volume"), "value_growth": change("avg")})
    category = long_form(sums, ["Category"], [c for c in sums.columns if c != "Category"], "metric")
    brands = inflows.where((F.col("period") == recent) & F.col("Category").isNotNull() & F.col("Brand").isNotNull()).groupBy("Category", "Brand").agg(F.sum("rows").alias("n"))
    brands = A.top_labels(brands, "Brand", 3, ["Category"])

    gifts = inflows.where(F.col("period") == recent).agg(F.sum("Quantity").alias("total_volume"), ratio(F.sum("Quantity"), F.sum("shipments")).alias("average_size"), F.sum("rows").alias("donations"))
    v = "Inventory_Level"
    levels = level.agg(F.avg(v).alias("average_level"), F.max(v).alias("peak_level"), F.min(v).alias("minimum_level"), ratio(F.stddev(v), F.avg(v), 0.0).alias("variation"))
    shown = attach(levels, gifts)

    parts = [
        row(advice, "recommendation", F.concat_ws("|", "priority", "title"), F.lit(1.0)),
        row(risks, "risk_alert", F.concat_ws("|", "severity", "type"), F.col("value")),
        row(per, "reorder_point", F.col("Category"), F.bround(P.LEAD_DAYS * mean + 1.5 * spread, 0)),
        row(stock, "safety_stock", F.concat_ws("|", *keys, "model", "service_level"), F.col("safety_stock")),
        row(turn, "turnover", F.col("label"), F.col("turnover")),
        row(category, "category", F.concat_ws("|", "Category", "metric"), F.col("value")),
        row(brands, "category_brand", F.concat_ws("|", "Category", "Brand"), F.col("n")),
        row(long_form(shown, [], shown.columns, "metric"), "performance", F.col("metric"), F.col("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("value").isNotNull())


def filtered_insights(inventory: DataFrame, flows: DataFrame, warehouses=None, categories=None, **more) -> DataFrame:
    """Insights on the flows of chosen warehouses and categories."""
    return insight_run(inventory, selected(flows, Warehouse=warehouses, Category=categories), **more)
