"""Reorder points, safety stock, efficiency, projections and their comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import aggregates as A
from .combine import top_k
from .frames import attach, known, over, ratio
from .ranks import quantiles

LEAD_DAYS = 7


def current_level(inventory: DataFrame) -> DataFrame:
    """Latest level and the mean over all days."""
    return inventory.agg(F.max_by("Inventory_Level", "Date").alias("current_level"), F.avg("Inventory_Level").alias("average_level"))


def reorder_by_category(outflows: DataFrame) -> DataFrame:
    """Lead time times mean shipment plus one and a half deviations."""
    d = known(outflows, ["Category"]).groupBy("Category").agg(F.avg("Quantity").alias("_m"), F.stddev("Quantity").alias("_s"))
    point = LEAD_DAYS * F.col("_m") + 1.5 * F.col("_s")
    return d.select("Category", F.bround("_m", 2).alias("avg_daily_demand"), F.bround("_s", 2).alias("demand_std"),
                    F.bround(point, 0).alias("reorder_point"))


def _cells(outflows: DataFrame) -> DataFrame:
    daily = known(outflows, ["Category", "Warehouse"]).groupBy("Category", "Warehouse", "Date").agg(F.sum("Quantity").alias("q"))
    return daily.groupBy("Category", "Warehouse").agg(
        F.sum("q").alias("total"), F.avg("q").alias("mean"), F.stddev("q").alias("std"), F.count(F.lit(1)).alias("days"),
        F.datediff(F.max("Date"), F.min("Date")).alias("span"))


def reorder_by_cell(outflows: DataFrame, inventory: DataFrame) -> DataFrame:
    """Reorder point per category and warehouse from demand over the covered span.

    Cells observed on one day only are left out.
    """
    c = _cells(outflows).where(F.col("span") > 0)
    demand = F.col("total") / F.col("span")
    spread = F.when(F.col("days") > 1, F.col("std")).otherwise(demand * 0.1)
    c = c.select("Category", "Warehouse", demand.alias("_d"), spread.alias("_s"))
    c = attach(c.withColumn("_p", LEAD_DAYS * F.col("_d") + 1.5 * F.col("_s")), current_level(inventory).select("current_level"))
    return c.select(
        "Category", "Warehouse", "current_level", F.bround("_p", 0).alias("reorder_point"), F.bround("_d", 2).alias("avg_daily_demand"),
        F.lit(LEAD_DAYS).alias("lead_time_days"), F.bround("_s", 2).alias("variability"),
        F.when(F.col("current_level") < F.col("_p"), "REORDER_NEEDED").otherwise("OK").alias("status"))


# Service level in percent and its normal quantile.
SERVICE_LEVELS = [("95.0%", 1.65), ("98.0%", 2.05), ("99.0%", 2.33)]


def safety_by_model(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Normal quantile times the mean absolute error for three service levels."""
    levels = F.explode(F.array(*[F.struct(F.lit(n).alias("service_level"), F.lit(z).alias("z")) for n, z in SERVICE_LEVELS]))
    rows = metrics.select(*keys, "model", "mae", levels.alias("l"))
    return rows.select(*keys, "model", "l.service_level", F.bround(F.col("l.z") * F.col("mae"), 0).alias("safety_stock"))


def safety_by_cell(outflows: DataFrame) -> DataFrame:
    """1.96 daily deviations over the root of the lead time; needs two days."""
    c = _cells(outflows).where(F.col("days") > 1)
    stock = 1.96 * F.col("std") * F.sqrt(F.lit(float(LEAD_DAYS)))
    return c.select("Category", "Warehouse", F.bround(stock, 0).alias("safety_stock"), F.bround("mean", 2).alias("avg_daily_demand"),
                    F.bround("std", 2).alias("demand_std"), F.lit("97.5%").alias("service_level"), F.lit(LEAD_DAYS).alias("lead_time_days"))


def optimisation(outflows: DataFrame, inventory: DataFrame, metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Reorder points, safety stock and turnover as rows (section, subject, value)."""
    row = lambda section, subject, value: [F.lit(section).alias("section"), subject.alias("subject"), value.cast("double").alias("value")]
    a = reorder_by_category(outflows).select(*row("reorder_point", F.col("Category"), F.col("reorder_point")))
    s = safety_by_model(metrics, keys)
    b = s.select(*row("safety_stock", F.concat_ws("|", *keys, "model", "service_level"), F.col("safety_stock")))
    t = A.turnover(inventory, outflows, "rows")
    c = t.select(*row("turnover", F.col("label"), F.col("turnover")))
    return a.unionByName(b).unionByName(c)


def daily_cube(flows: DataFrame) -> DataFrame:
    """Quantity, its squared deviations and count of shipments by flow, category, warehouse and day."""
    q = F.col("Quantity").cast("double")
    return flows.groupBy("flow", "Category", "Warehouse", "Date").agg(
        F.sum(q).alias("Quantity"), (F.var_pop(q) * F.count(q)).alias("squares"), F.count(q).alias("shipments"), F.count(F.lit(1)).alias("rows"))


def dimension_cube(flows: DataFrame, period: str = "period") -> DataFrame:
    """What the live insights need of the shipments, by flow, period, category, brand and warehouse."""
    q = F.col("Quantity").cast("double")
    return flows.groupBy("flow", F.col(period).alias("period"), "Category", "Brand", "Warehouse").agg(
        F.sum(q).alias("Quantity"), (F.var_pop(q) * F.count(q)).alias("squares"), F.count(q).alias("shipments"), F.count(F.lit(1)).alias("rows"),
        F.sum("Total_GIK").alias("Total_GIK"), F.count("Total_GIK").alias("valued"))


def merged_moments(cells: DataFrame, keys: Sequence[str], n: str = "shipments", total: str = "Quantity", squares: str = "squares") -> DataFrame:
    """total, count and squared deviations (m2) per key from cells that hold their own.

    The cells' deviations from the key's mean are added to those inside the cells, so nothing large is
    subtracted from something large.
    """
    held = cells.where(F.col(n) > 0)
    whole = held.groupBy(*keys).agg(F.sum(total).alias("total"), F.sum(n).alias("count"))
    rows = attach(held, whole.select(*keys, (F.col("total") / F.col("count")).alias("_mean")), keys)
    off = F.col(total) / F.col(n) - F.col("_mean")
    return whole.join(rows.groupBy(*keys).agg(F.sum(F.col(squares) + F.col(n) * off * off).alias("m2")), list(keys))


def middle_day(cube: DataFrame) -> DataFrame:
    """Median day number over the rows behind a cube; the window holds one row for each day."""
    day = F.datediff("Date", F.lit("1970-01-01").cast("date"))
    days = cube.where(F.col("Date").isNotNull()).groupBy(day.alias("_day")).agg(F.sum("rows").alias("_n"))
    every = over([])
    days = days.select("_day", F.sum("_n").over(over([], "_day")).alias("_upto"), F.sum("_n").over(every).alias("_all"))
    at = lambda half: F.min(F.when(F.col("_upto") > half, F.col("_day")))
    low, high = F.floor((F.col("_all") - 1) / 2), F.ceil((F.col("_all") - 1) / 2)
    return days.agg(((at(low) + at(high)) / 2).alias("_mid"))


def category_trends(inflows: DataFrame, limit: float = 20.0, k: int = 5, middle: DataFrame | None = None) -> DataFrame:
    """Categories whose volume after the median date grew or fell beyond a limit.

    `middle` brings the median when `inflows` are daily sums.
    """
    days = inflows.withColumn("_day", F.datediff("Date", F.lit("1970-01-01").cast("date")))
    days = attach(days, quantiles(days, "_day", {"_mid": 0.5}) if middle is None else middle)
    early = F.col("_day") <= F.col("_mid")
    t = known(days, ["Category"]).groupBy("Category").agg(
        F.sum(F.when(early, F.col("Quantity"))).alias("early"), F.sum(F.when(~early, F.col("Quantity"))).alias("late"))
    growth = ratio(F.col("late") - F.col("early"), F.col("early")) * 100
    t = t.where((F.col("early") > 0) & F.col("late").isNotNull()).withColumn("growth", growth)
    kind = F.when(F.col("growth") > limit, "growing").when(F.col("growth") < -limit, "declining")
    t = t.withColumn("kind", kind).where(F.col("kind").isNotNull()).withColumn("_size", F.abs("growth"))
    return top_k(t, "_size", k, "Category", ["kind"]).drop("_size")


def warehouse_efficiency(flows: DataFrame) -> DataFrame:
    """Outflow over inflow per warehouse, score capped at 100, band."""
    p = A.flow_performance(flows.select("flow", "Warehouse", "Quantity"), "Warehouse")
    through = F.when(F.col("in_sum") > 0, ratio("out_sum", "in_sum")).otherwise(0.0)
    score = F.least(through, F.lit(1.0)) * 100
    avg = lambda c: F.bround(F.coalesce(F.col(c), F.lit(0.0)), 0)
    return p.select(
        "Warehouse", F.col("in_sum").alias("total_inflows"), F.col("out_sum").alias("total_outflows"), through.alias("throughput"),
        score.alias("score"), avg("in_mean").alias("avg_inflow"), avg("out_mean").alias("avg_outflow"),
        F.when(score > 80, "High").when(score > 60, "Medium").otherwise("Low").alias("status"))


def category_spread(cube: DataFrame) -> DataFrame:
    """Total and deviation of shipments per category, from the deviations of the cube's cells."""
    m = merged_moments(known(cube, ["Category"]), ["Category"])
    return m.select("Category", F.col("total").alias("_t"), F.when(F.col("count") > 1, F.sqrt(F.col("m2") / (F.col("count") - 1))).alias("_s"))


def opportunities(outflows: DataFrame | None, inventory: DataFrame, per: DataFrame | None = None) -> DataFrame:
    """Three slowest and two most variable categories, and an excess level; `per` as from `category_spread`."""
    if per is None:
        per = known(outflows, ["Category"]).groupBy("Category").agg(F.sum("Quantity").alias("_t"), F.stddev("Quantity").alias("_s"))
    out = lambda df, kind, subject, value, priority: df.select(
        F.lit(kind).alias("type"), subject.alias("category"), value.alias("value"), F.lit(priority).alias("priority"))
    slow = out(top_k(per, "_t", 3, "Category", largest=False), "SLOW_MOVING_INVENTORY", F.col("Category"), F.col("_t"), "Medium")
    wild = out(top_k(per, "_s", 2, "Category"), "HIGH_DEMAND_VARIABILITY", F.col("Category"), F.col("_s"), "High")
    now = current_level(inventory).where(F.col("current_level") > F.col("average_level") * 1.5)
    excess = out(now, "EXCESS_INVENTORY", F.lit("Overall"), F.col("current_level"), "Medium")
    return slow.unionByName(wild).unionByName(excess)


# ---------------------------------------------------------------- projection

SCENARIO = "scenario string, reorder_point double, safety_stock double, lead_time_days int, order_quantity double, initial_inventory double"


def project(forecasts: DataFrame, scenarios: DataFrame, keys: Sequence[str] = (), demand_share: float = 0.01) -> DataFrame:
    """Fold each forecast day by day under each scenario's ordering policy.

    A day receives a due order, orders at the reorder point, loses the demand,
    orders again below the safety stock. At most one order is pending. The
    state is (level, due date); one array of at most `horizon` days per series
    feeds a JVM-side fold.
    """
    ids = [*keys, "scenario"]
    days = forecasts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ds", "yhat"))).alias("_days"))
    policies = scenarios.agg(F.collect_list(F.struct(*scenarios.columns)).alias("_s"))
    pairs = attach(days, policies).select(*keys, "_days", F.inline("_s"))
    start = F.coalesce(F.col("initial_inventory"), F.col("_days")[0]["yhat"])
    row = "array<struct<ds:date,inventory_level:double,forecast_demand:double,pending:boolean,stockout:boolean>>"
    zero = F.struct(start.alias("level"), F.lit(None).cast("date").alias("due"), F.array().cast(row).alias("rows"))

    def step(acc, day):
        arrived = F.coalesce(acc["due"] <= day["ds"], F.lit(False))
        level = F.when(arrived, acc["level"] + F.col("order_quantity")).otherwise(acc["level"])
        open_due = F.when(~arrived, acc["due"])
        next_due = F.date_add(day["ds"], F.col("lead_time_days"))
        ordered = F.when((level <= F.col("reorder_point")) & open_due.isNull(), next_due).otherwise(open_due)
        after = F.greatest(F.lit(0.0), level - F.abs(day["yhat"]) * demand_share)
        urgent = F.when((after < F.col("safety_stock")) & ordered.isNull(), next_due).otherwise(ordered)
        entry = F.struct(day["ds"].alias("ds"), after.alias("inventory_level"), F.abs(day["yhat"]).alias("forecast_demand"),
                         urgent.isNotNull().alias("pending"), (after < F.col("safety_stock")).alias("stockout"))
        return F.struct(after.alias("level"), urgent.alias("due"), F.concat(acc["rows"], F.array(entry)).alias("rows"))

    folded = pairs.withColumn("_r", F.aggregate("_days", zero, step, lambda acc: acc["rows"]))
    return folded.select(*ids, F.inline("_r"))


def stock_cover(forecasts: DataFrame, scenarios: DataFrame, keys: Sequence[str] = (), demand_share: float = 0.01) -> DataFrame:
    """When the stock runs out under each scenario, and whether one order in time prevents it.

    Demand is added up along each series by a window and held against the scenario's levels, so no day
    depends on a decision of the day before. reorder_date, safety_date and stock_out_date are the first days
    whose level is at the reorder point, below the safety stock, at zero; missing where that never happens.
    arrival_date is lead_time_days after reorder_date; what depends on it is missing where it lies beyond the
    last forecast day. `late` tells that the stock runs out before the order arrives. Days without a
    forecast take no demand; repeated days add up.
    """
    ids = [*keys, "scenario"]
    known_days = known(forecasts, [*keys, "ds", "yhat"])
    daily = known_days.groupBy(*keys, "ds").agg(F.sum(F.abs("yhat") * demand_share).alias("_d"), F.max("yhat").alias("_y"))
    so_far = over(keys, "ds")
    daily = daily.withColumn("_used", F.sum("_d").over(so_far)).withColumn("_first", F.first("_y").over(so_far))
    policies = scenarios.agg(F.collect_list(F.struct(*scenarios.columns)).alias("_s"))
    rows = attach(daily, policies).select(*keys, "ds", "_d", "_used", "_first", F.inline("_s"))
    start = F.coalesce("initial_inventory", "_first")
    rows = rows.withColumn("_start", start).withColumn("_level", start - F.col("_used"))
    reorder = F.min(F.when(F.col("_level") <= F.col("reorder_point"), F.col("ds"))).over(over(ids))
    rows = rows.withColumn("_reorder", reorder).withColumn("_arrival", F.date_add("_reorder", F.col("lead_time_days")))
    first = lambda cond: F.min(F.when(cond, F.col("ds")))
    until = F.col("ds") <= F.col("_arrival")
    out = rows.groupBy(*ids).agg(
        F.max("_start").alias("start_level"), F.min("_reorder").alias("reorder_date"),
        first(F.col("_level") < F.col("safety_stock")).alias("safety_date"), first(F.col("_level") <= 0).alias("stock_out_date"),
        F.min("_arrival").alias("arrival_date"), F.max("ds").alias("_end"), F.min("ds").alias("_begin"), F.max("safety_stock").alias("_safe"),
        F.sum(F.when(until & (F.col("ds") > F.col("_reorder")), F.col("_d"))).alias("_lead"),
        F.min(F.when(until, F.col("_level"))).alias("_left"))
    inside = F.col("arrival_date") <= F.col("_end")
    return out.select(
        *ids, "start_level", "reorder_date", "safety_date", "stock_out_date", "arrival_date",
        F.datediff("stock_out_date", "_begin").alias("cover_days"),
        F.when(inside, F.col("_lead")).alias("lead_demand"), F.when(inside, F.col("_left")).alias("level_before_arrival"),
        F.when(inside, F.greatest(F.lit(0.0), F.col("_safe") - F.col("_left"))).alias("short_of_safety"),
        F.coalesce(F.col("stock_out_date") <= F.col("arrival_date"), F.lit(False)).alias("late"))


def compare_cover(cover: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Scenarios by safety: those whose order comes in time first, then the latest stock-out (none at all is
    the latest), then the smallest shortfall."""
    never = F.col("stock_out_date").isNull().cast("int")
    order = [F.asc("late"), F.desc(never), F.desc("cover_days"), F.asc_nulls_last("short_of_safety"), "scenario"]
    return cover.select(*keys, "scenario", "late", "cover_days", "short_of_safety", F.row_number().over(over(keys, *order)).alias("rank"))


def scenario_metrics(projection: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Stockout days, level range, pending days, orders placed and service level."""
    ids = [*keys, "scenario"]
    fresh = F.col("pending") & ~F.coalesce(F.lag("pending").over(over(ids, "ds")), F.lit(False))
    rows = projection.withColumn("_new", fresh)
    n = F.count(F.lit(1))
    out = F.count_if("stockout")
    return rows.groupBy(*ids).agg(
        out.alias("stockout_days"), F.avg("inventory_level").alias("avg_inventory"), F.min("inventory_level").alias("min_inventory"),
        F.max("inventory_level").alias("max_inventory"), F.count_if("pending").alias("pending_days"),
        F.count_if("_new").alias("pending_spells"), ((n - out) * 100.0 / n).alias("service_level"))


def compare_scenarios(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Risk band per scenario and marks for the best by three criteria."""
    balance = F.col("service_level") * 0.6 + (100 - F.col("stockout_days")) * 0.4
    out = metrics.withColumn("_b", balance)
    first = lambda *order: F.row_number().over(over(keys, *order, "scenario")) == 1
    s = F.col("stockout_days")
    return out.select(
        *metrics.columns, F.when(s > 10, "High").when(s > 5, "Medium").otherwise("Low").alias("risk_level"),
        first(F.desc("service_level")).alias("best_service"), first(F.asc("avg_inventory")).alias("best_inventory"),
        first(F.desc("_b")).alias("best_overall"))
