"""Schema checks, row rules, quality profiles and cleaning suggestions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktide import schemas

from .frames import attach, attach_written, has, known, long_form, numeric_columns, over, present, rows_of
from .ranks import counted, median_deviation_of, moments_of, quantiles, quantiles_of, shape_columns


def missing_columns(spark: SparkSession, tables: dict[str, DataFrame], level: str = "full") -> DataFrame:
    """One row per required column a table lacks."""
    absent = [(name, c) for name, df in tables.items() for c in schemas.REQUIRED[level][name] if c not in df.columns]
    return rows_of(spark, [(level, n, c) for n, c in absent], "level string, dataset string, column string")


def row_rules(df: DataFrame, raw: DataFrame | None = None) -> dict[str, Column]:
    """Rule name -> condition of a violating row, for the columns present."""
    rules = {}
    if has(df, "Date"):
        rules["invalid_date"] = F.col("Date").isNull()
    if has(df, "Inventory_Level"):
        rules["level_not_numeric"] = F.col("Inventory_Level").isNull()
        rules["level_negative"] = F.col("Inventory_Level") < 0
    if has(df, "Quantity"):
        rules["quantity_not_numeric"] = F.col("Quantity").isNull()
        rules["quantity_not_positive"] = F.col("Quantity") <= 0
    if has(df, "GIK_Per_Unit"):
        rules["unit_value_extreme"] = F.col("GIK_Per_Unit") > 10000
    return rules


def count_rules(df: DataFrame, rules: dict[str, Column], name="rule") -> DataFrame:
    """Violations per rule, all counted in one pass."""
    counted = df.agg(*[F.count_if(c).alias(r) for r, c in rules.items()])
    return counted.unpivot([], list(rules), name, "n")


def required_periods(datasets: DataFrame) -> DataFrame:
    """Inventory periods that must exist but do not; `datasets` has type, period."""
    spark = datasets.sparkSession
    need = rows_of(spark, [("inventory", "train"), ("inventory", "tune")], "type string, period string")
    return need.join(datasets.select("type", "period").distinct(), ["type", "period"], "left_anti")


def quality_issues(df: DataFrame) -> DataFrame:
    """Duplicate dates, missing cells per column, too many values outside p1..p99."""
    cols = df.columns
    checks = [(F.count("Date") - F.countDistinct("Date")).alias("duplicate_dates")] if has(df, "Date") else []
    checks += [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in cols]
    names = (["duplicate_dates"] if has(df, "Date") else []) + [f"missing_{c}" for c in cols]
    found = df.agg(*checks).unpivot([], names, "issue", "n").where(F.col("n") > 0)
    if has(df, "Inventory_Level"):
        v = F.col("Inventory_Level")
        banded = attach(df, quantiles(df, "Inventory_Level", {"_lo": 0.01, "_hi": 0.99}))
        tail = banded.agg(F.count_if((v < F.col("_lo")) | (v > F.col("_hi"))).alias("n"), F.count(F.lit(1)).alias("_all"))
        found = found.unionByName(
            tail.where(F.col("n") > F.col("_all") * 0.05).select(F.lit("level_outliers").alias("issue"), "n"))
    return found


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*order).limit(n)


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, rows and missing cells."""
    kinds = dict(df.dtypes)
    filled = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    long = filled.unpivot(["_rows"], df.columns, "column", "filled")
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return long.select("column", kind[F.col("column")].alias("type"), F.col("_rows").alias("rows"),
                       (F.col("_rows") - F.col("filled")).alias("missing"))


def date_span(df: DataFrame, date="Date", keys=()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(date).alias("start"), F.max(date).alias("end"), F.datediff(F.max(date), F.min(date)).alias("total_days"))


def describe(df: DataFrame, columns: Sequence[str] | None = None, keys=()) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column."""
    columns = list(columns or numeric_columns(df))
    ids = [*keys, "column"]
    long = known(long_form(df, keys, columns), ["value"])
    counts = counted(long, "value", ids)
    base = moments_of(counts, "value", ids).select(*ids, *shape_columns()).select(*ids, "count", "mean", "std", "min", "max")
    return attach(base, quantiles_of(counts, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ids), ids)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in every column.

    Grouping by all columns combines copies before the shuffle, so a row copied
    many times never gathers in one task.
    """
    same = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return same.agg(F.sum(F.col("_n") - 1).alias("duplicates"), F.sum("_n").alias("rows"))


def outlier_flags(df: DataFrame, columns: Sequence[str], keys=()) -> DataFrame:
    """Long rows (keys, column, value) with one flag per detection method."""
    ids = [*keys, "column"]
    long = known(long_form(df, keys, columns), [*ids, "value"])
    return _flagged(long, counted(long, "value", ids), ids)


def _flagged(rows: DataFrame, counts: DataFrame, ids: Sequence[str]) -> DataFrame:
    """`rows` with the flags; every bound is read from the written counts."""
    params = moments_of(counts, "value", ids).select(*ids, F.col("mean").alias("_mean"), F.when(F.col("max") > F.col("min"), F.sqrt(F.col("m2") / F.col("count"))).otherwise(0.0).alias("_sd"))
    params = params.join(quantiles_of(counts, "value", {"_q1": 0.25, "_q3": 0.75}, ids), ids).join(median_deviation_of(counts, "value", ids), ids)
    v, iqr = F.col("value"), F.col("_q3") - F.col("_q1")
    low, high = F.col("_q1") - 1.5 * iqr, F.col("_q3") + 1.5 * iqr
    z = F.abs(F.try_divide(v - F.col("_mean"), F.col("_sd")))
    mz = F.abs(F.try_divide(0.6745 * (v - F.col("median")), F.col("mad")))
    no = F.lit(False)
    return attach_written(rows, params, ids).select(
        *rows.columns, low.alias("low"), high.alias("high"),
        ((v < low) | (v > high)).alias("iqr"), F.coalesce(z > 3, no).alias("zscore"),
        F.coalesce(mz > 3.5, no).alias("modified_zscore"))


def outlier_counts(df: DataFrame, columns: Sequence[str], keys=()) -> DataFrame:
    """Per column: bounds, hits per method and in total, share in percent."""
    ids = [*keys, "column"]
    counts = counted(known(long_form(df, keys, columns), [*ids, "value"]), "value", ids)
    flags = _flagged(counts, counts, ids)  # equal values share their flags: the counts stand for the rows
    any_hit = F.col("iqr") | F.col("zscore") | F.col("modified_zscore")
    hits = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return flags.groupBy(*ids).agg(
        F.max("low").alias("low"), F.max("high").alias("high"), hits(F.col("iqr")).alias("iqr"),
        hits(F.col("zscore")).alias("zscore"), hits(F.col("modified_zscore")).alias("modified_zscore"),
        hits(any_hit).alias("total"), (hits(any_hit) * 100.0 / F.sum("n")).alias("percentage"))


def assessment(df: DataFrame, numeric: Sequence[str] | None = None) -> DataFrame:
    """Long report (metric, subject, value) over missing, duplicates, types, outliers."""
    spark = df.sparkSession
    prof = column_profile(df)
    share = F.try_divide(F.col("missing") * 100.0, F.col("rows").cast("double"))
    row = lambda metric, subject, value: [F.lit(metric).alias("metric"), subject.alias("subject"), value.cast("double").alias("value")]
    several = lambda df, *rows: df.select(F.inline(F.array(*[F.struct(*r) for r in rows])))
    types = Counter(t for _, t in df.dtypes)
    dup = duplicate_rows(df)
    out = outlier_counts(df, numeric or numeric_columns(df))
    parts = [
        several(prof, row("missing", F.col("column"), F.col("missing")), row("missing_pct", F.col("column"), share)),
        rows_of(spark, [("columns_of_type", t, n) for t, n in types.items()], "metric string, subject string, value double"),
        several(dup, row("duplicates", F.lit("rows"), F.col("duplicates")),
                row("duplicates_pct", F.lit("rows"), F.try_divide(F.col("duplicates") * 100.0, F.col("rows").cast("double")))),
        several(out, row("outliers", F.col("column"), F.col("total")), row("outliers_pct", F.col("column"), F.col("percentage"))),
    ]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def consistency(df: DataFrame, as_of: str) -> DataFrame:
    """Negative measures, values above a million and dates after `as_of`."""
    rules = {f"{c}_negative_values": F.col(c) < 0 for c in present(df, ["Quantity", "Inventory_Level", "Total_GIK", "GIK_Per_Unit"])}
    rules |= {f"{c}_extreme_values": F.col(c) > 1e6 for c in numeric_columns(df)}
    if has(df, "Date"):
        rules["future_dates"] = F.col("Date") > F.lit(as_of).cast("date")
    return count_rules(df, rules, "issue").where(F.col("n") > 0)


def suggestions(report: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Actions implied by an assessment: (action, subject)."""
    m, v = F.col("metric"), F.col("value")
    action = (
        F.when((m == "missing_pct") & (v > 50), "remove_column")
        .when((m == "missing_pct") & (v > 10), "impute_column")
        .when((m == "duplicates") & (v > 0), "remove_duplicates")
        .when((m == "outliers_pct") & (v > 5), "review_outliers"))
    out = report.select(action.alias("action"), "subject").where(F.col("action").isNotNull())
    if issues is not None:
        out = out.unionByName(issues.select(F.lit("fix_consistency").alias("action"), F.col("issue").alias("subject")))
    return out


def gap_profile(df: DataFrame, keys=(), date="Date") -> DataFrame:
    """Span and gaps between distinct observed dates, with their row counts.

    Repeated dates are gaps of zero days; they enter through the counts so the
    window sees one row per day.
    """
    days = known(df, [date]).groupBy(*keys, date).agg(F.count(F.lit(1)).alias("_n"))
    days = days.withColumn("_gap", F.datediff(F.col(date), F.lag(date).over(over(keys, date))))
    out = days.groupBy(*keys).agg(
        F.min(date).alias("start"), F.max(date).alias("end"), F.sum("_n").alias("data_points"),
        F.coalesce(F.max("_gap"), F.lit(0)).alias("maximum_gap_days"))
    span = F.datediff("end", "start")
    mean = F.coalesce(F.floor(F.try_divide(span.cast("double"), (F.col("data_points") - 1).cast("double"))), F.lit(0))
    return out.withColumn("total_days", span).withColumn("average_gap_days", mean).withColumn("has_gaps", F.col("maximum_gap_days") > 1)


def processed_summary(inventory: DataFrame, inflows: DataFrame, outflows: DataFrame) -> DataFrame:
    """Record counts, overall date range and level statistics in one row."""
    v = "Inventory_Level"
    stock = inventory.agg(
        F.count(F.lit(1)).alias("inventory_records"), F.min("Date").alias("_a0"), F.max("Date").alias("_b0"),
        F.avg(v).alias("mean"), F.stddev(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    for i, (name, df) in enumerate((("inflows", inflows), ("outflows", outflows)), 1):
        stock = attach(stock, df.agg(
            F.count(F.lit(1)).alias(f"{name}_records"), F.min("Date").alias(f"_a{i}"), F.max("Date").alias(f"_b{i}")))
    return stock.withColumn("start", F.least("_a0", "_a1", "_a2")).withColumn("end", F.greatest("_b0", "_b1", "_b2"))
