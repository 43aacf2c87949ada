"""Cleaning: typing, missing values, extreme values, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide import schemas
from stocktide.functions.scalars import parse_date, to_number
from stocktide.session import materialize

from . import series
from .frames import attach, has, known, present, ratio, string_columns
from .outliers import fences
from .ranks import column_quantiles, median_deviation, order_statistics, ordered_codes, quantiles

# ---------------------------------------------------------------- extreme values


def bounded(df: DataFrame, bounds: DataFrame, keys=()) -> DataFrame:
    """Add bounds to rows. Those per key are written first: Spark then knows their size, and only
    beyond its broadcast threshold shuffles the rows, with skewed keys split by adaptive execution."""
    return attach(df, materialize(bounds, "bounds") if keys else bounds, keys)


def clip(df: DataFrame, value: str, bounds: DataFrame, keys=()) -> DataFrame:
    """Pull values into [low, high]; missing values and bounds leave them as is."""
    out = bounded(df, bounds, keys)
    v = F.col(value)
    capped = F.when(v < F.col("low"), F.col("low")).when(v > F.col("high"), F.col("high")).otherwise(v)
    return out.withColumn(value, capped).select(*df.columns)


def winsorize(df: DataFrame, value: str, keys=(), lower=0.01, upper=0.99) -> DataFrame:
    return clip(df, value, quantiles(df, value, {"low": lower, "high": upper}, keys), keys)


def winsorize_columns(df: DataFrame, columns: Sequence[str], keys=(), lower=0.01, upper=0.99) -> DataFrame:
    """Winsorize several columns from one pass over the data."""
    if not columns:
        return df
    out = bounded(df, column_quantiles(df, columns, {"low": lower, "high": upper}, keys), keys)
    capped = {
        c: F.when(F.col(c) < F.col(f"{c}_low"), F.col(f"{c}_low"))
        .when(F.col(c) > F.col(f"{c}_high"), F.col(f"{c}_high")).otherwise(F.col(c))
        for c in columns
    }
    return out.withColumns(capped).select(*df.columns)


def clip_to_fence(df: DataFrame, value: str, keys=(), k: float = 1.5) -> DataFrame:
    return clip(df, value, fences(df, value, keys, k), keys)


def cap_extremes(df: DataFrame, factors: dict[str, float], keys=()) -> DataFrame:
    """Values beyond `factor` times the column's 99th percentile become that percentile."""
    out = bounded(df, column_quantiles(df, list(factors), {"p99": 0.99}, keys), keys)
    capped = {
        c: F.when(F.col(c) > F.col(f"{c}_p99") * k, F.col(f"{c}_p99")).otherwise(F.col(c)) for c, k in factors.items()
    }
    return out.withColumns(capped).select(*df.columns)


def winsorize_by_rank(df: DataFrame, value: str, keys=(), limits=(0.01, 0.01)) -> DataFrame:
    """Replace the floor(limit * n) smallest and largest values by the next kept one."""
    return clip(df, value, order_statistics(df, value, limits, keys), keys)


# ---------------------------------------------------------------- typing and missing


def typed(df: DataFrame, kind: str, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Dates and measures from text; unreadable cells become missing."""
    out = {}
    types = dict(df.dtypes)
    if has(df, "Date"):
        out["Date"] = parse_date(F.col("Date"), fmt) if types["Date"] == "string" else F.col("Date").cast("date")
    for c in present(df, schemas.NUMERIC[kind]):
        out[c] = to_number(F.col(c))
    return df.withColumns(out)


def drop_incomplete(df: DataFrame, columns: Sequence[str], how: str = "any") -> DataFrame:
    return df.na.drop(how=how, subset=list(columns))


def fill_missing(df: DataFrame, medians=(), zeros=(), unknown=()) -> DataFrame:
    """Column median, zero or 'Unknown' in place of missing cells."""
    if medians:
        filled = attach(df, column_quantiles(df, medians, {"m": 0.5}))
        df = filled.withColumns({c: F.coalesce(c, f"{c}_m") for c in medians}).select(*df.columns)
    return df.na.fill(0.0, list(zeros)).na.fill("Unknown", list(unknown))


# ---------------------------------------------------------------- composed cleaning


def clean_live(df: DataFrame, kind: str, fmt: str = "yyyy-MM-dd", how: str = "all") -> DataFrame:
    """Type, drop rows without a date, winsorize value columns, drop empty rows."""
    out = typed(df, kind, fmt).where(F.col("Date").isNotNull())
    out = winsorize_columns(out, present(out, schemas.VALUE_COLUMNS))
    return drop_incomplete(out, schemas.REQUIRED["minimal"][kind], how)


def clean_table(df: DataFrame, kind: str, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Type, drop rows lacking a critical cell, fill the rest, winsorize the value."""
    out = drop_incomplete(typed(df, kind, fmt), schemas.REQUIRED["minimal"][kind])
    if kind == "inventory":
        return out
    measures = present(out, ["Quantity", "GIK_Per_Unit", "Total_GIK"])
    out = fill_missing(out, zeros=measures, unknown=present(out, schemas.DIMENSIONS[kind]))
    return winsorize(out, "Total_GIK") if has(out, "Total_GIK") else out


def label_codes(df: DataFrame, label: str, name: str) -> DataFrame:
    """Position of each label in sorted order, from 0; missing labels get -1."""
    codes = ordered_codes(known(df.select(label), [label]).distinct(), label, name)
    return df.join(codes, label, "left").na.fill(-1, [name]).select(*df.columns, name)


def engineered(df: DataFrame, kind: str, keys=()) -> DataFrame:
    cal = series.calendar_columns("Date")
    names = {"Year": "year", "Month": "month", "Quarter": "quarter", "DayOfWeek": "dayofweek", "DayOfYear": "dayofyear"}
    df = df.withColumns({k: cal[v] for k, v in names.items()})
    if kind == "inventory":
        v = "Inventory_Level"
        df = series.lags(df, keys, "Date", v, (1, 7), "Inventory_Lag")
        df = df.withColumns({
            "Inventory_MA7": series.rolling(keys, "Date", v, 7)["rolling_mean_7"],
            "Inventory_MA30": series.rolling(keys, "Date", v, 30)["rolling_mean_30"]})
        df = series.changes(df, keys, "Date", v)
        return df.withColumnsRenamed({"diff": "Inventory_Change", "pct_change": "Inventory_PctChange"})
    if has(df, "Quantity", "GIK_Per_Unit"):
        df = df.withColumn("Total_Value", F.col("Quantity") * F.col("GIK_Per_Unit"))
    for c in present(df, ["Product_Type", "Category"]):
        df = label_codes(df, c, f"{c}_Encoded")
    return df


def prepare_stock(df: DataFrame, order: Sequence[str], fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Stock readings: type, interpolate by time, one per day, fence, features, scale."""
    out = typed(df, "inventory", fmt).where(F.col("Date").isNotNull())
    out = series.keep_last(out, [], "Date", order)
    out = series.interpolate(out, [], "Date", "Inventory_Level", by="time")
    middle = out.agg(F.percentile("Inventory_Level", 0.5).alias("_m"))
    out = attach(out, middle).withColumn("Inventory_Level", F.coalesce("Inventory_Level", "_m")).drop("_m")
    out = engineered(clip_to_fence(out, "Inventory_Level"), "inventory")
    return robust_scale(out, "Inventory_Level", "Inventory_Level_Scaled")


def prepare_flows(df: DataFrame, kind: str, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Flow rows: type, fill, cap extreme unit values and quantities, features."""
    out = typed(df, kind, fmt).where(F.col("Date").isNotNull())
    out = fill_missing(out, medians=present(out, schemas.NUMERIC[kind]), unknown=present(out, string_columns(out)))
    # How far beyond the 99th percentile an entry counts as an error.
    limits = {"GIK_Per_Unit": 10, "Quantity": 5}
    return engineered(cap_extremes(out, {c: limits[c] for c in present(out, limits)}), kind)


def process_periods(inventory: DataFrame, inflows: DataFrame, outflows: DataFrame | None) -> dict[str, DataFrame]:
    """Clean period-tagged tables and derive daily features per period.

    One job per table covers every period; the winsorizing bounds are per period.
    """
    from . import aggregates as A

    def cleaned(df, kind):
        out = typed(df, kind).where(F.col("Date").isNotNull())
        out = winsorize_columns(out, present(out, schemas.VALUE_COLUMNS), ["period"])
        return drop_incomplete(out, schemas.REQUIRED["minimal"][kind], "all")

    done = {"inventory": cleaned(inventory, "inventory"), "inflows": cleaned(inflows, "inflows")}
    if outflows is not None:
        done["outflows"] = cleaned(outflows, "outflows")
    # A day belongs to one period, so features by day are features by period. They
    # use quantities only, which winsorizing leaves alone, so they skip that step
    # and share one written table of daily sums.
    def daily(df, kind):
        days = typed(df, kind).where(F.col("Date").isNotNull()).groupBy("Date", *present(df, ["Warehouse", "Category"]))
        return materialize(days.agg(F.sum("Quantity").alias("Quantity")), "daily")

    fin = daily(inflows, "inflows")
    fout = None if outflows is None else daily(outflows, "outflows")
    if has(inflows, "Warehouse"):
        done["warehouse_features"] = A.warehouse_features(fin, fout)
    if has(inflows, "Category"):
        done["category_features"] = A.category_features(fin, fout)
    return done


# ---------------------------------------------------------------- scaling


def normalize(df: DataFrame, value: str, method: str = "minmax", keys=()) -> DataFrame:
    """minmax (constant gives 0.5), zscore or robust (no spread gives 0)."""
    v = F.col(value).cast("double")
    if method == "minmax":
        p = known(df, [*keys, value]).groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
        center, scale, flat = F.col("_a"), F.col("_b") - F.col("_a"), 0.5
    elif method == "zscore":
        p = known(df, [*keys, value]).groupBy(*keys).agg(F.avg(value).alias("_a"), F.stddev(value).alias("_b"))
        center, scale, flat = F.col("_a"), F.col("_b"), 0.0
    elif method == "robust":
        p = median_deviation(df, value, keys).withColumnsRenamed({"median": "_a", "mad": "_b"})
        center, scale, flat = F.col("_a"), F.col("_b"), 0.0
    else:
        raise ValueError(f"unknown method {method}")
    out = attach(df, p, keys)
    scaled = F.when(scale == 0, F.lit(flat)).otherwise(ratio(v - center, scale))
    return out.withColumn("normalized", scaled).select(*df.columns, "normalized")


def scale_parameters(train: DataFrame, value: str, keys=()) -> DataFrame:
    """Mean and population deviation; no deviation scales by 1."""
    sd = F.stddev_pop(value)
    return train.groupBy(*keys).agg(
        F.avg(value).alias("center"), F.when(sd > 0, sd).otherwise(1.0).alias("scale"))


def standardize(df: DataFrame, params: DataFrame, columns: Sequence[str], keys=(), inverse=False) -> DataFrame:
    out = attach(df, params, keys)
    move = (lambda c: F.col(c) * F.col("scale") + F.col("center")) if inverse else (
        lambda c: (F.col(c) - F.col("center")) / F.col("scale"))
    return out.withColumns({c: move(c) for c in columns}).select(*df.columns)


def robust_scale(df: DataFrame, value: str, name: str, keys=()) -> DataFrame:
    """(value - median) / IQR as an extra column; no spread divides by 1."""
    p = quantiles(df, value, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}, keys)
    out = attach(df, p, keys)
    iqr = F.col("_q3") - F.col("_q1")
    scaled = (F.col(value) - F.col("_q2")) / F.when(iqr == 0, 1.0).otherwise(iqr)
    return out.withColumn(name, scaled).select(*df.columns, name)


# ---------------------------------------------------------------- selection


def between_dates(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    if start:
        df = df.where(F.col("Date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("Date") <= F.lit(end).cast("date"))
    return df


def matching(df: DataFrame, **equal) -> DataFrame:
    """Equality filters; a filter on an absent column is ignored."""
    for column, wanted in equal.items():
        if wanted is not None and has(df, column):
            df = df.where(F.col(column) == wanted)
    return df


def selected(df: DataFrame, **choices) -> DataFrame:
    """Membership filters; no choice or an absent column keeps every row."""
    for column, values in choices.items():
        if values and has(df, column):
            df = df.where(F.col(column).isin(list(values)))
    return df


def positive(df: DataFrame, value: str = "Quantity") -> DataFrame:
    return df.where(F.col(value) > 0)
