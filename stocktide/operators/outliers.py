"""Outlier detection: fences, z-scores, isolation trees, combined reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.session import materialize

from . import series as S
from .frames import attach, attach_written, known, over, ratio
from .ranks import median_deviation, moments_of, quantiles, quantiles_of


def fences(df: DataFrame, value: str, keys: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """Bounds k quartile spreads outside the quartiles, one row per key."""
    return _fences(quantiles(df, value, {"q1": 0.25, "q3": 0.75}, keys), keys, k)


def _fences(q: DataFrame, keys: Sequence[str], k: float = 1.5) -> DataFrame:
    spread = (F.col("q3") - F.col("q1")) * k
    return q.select(*keys, (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))


def fence_rows(df: DataFrame, value: str, keys: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    out = attach_written(known(df, [*keys, value]), fences(df, value, keys, k), keys)
    return out.where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))


def zscore_rows(df: DataFrame, value: str, keys: Sequence[str] = (), limit: float = 3.0, nulls_as_zero=False) -> DataFrame:
    """Rows further than `limit` population deviations from the mean."""
    v = F.coalesce(F.col(value), F.lit(0.0)) if nulls_as_zero else F.col(value)
    stats = df.groupBy(*keys).agg(F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_sd"))
    out = attach_written(df, stats, keys).withColumn("score", F.abs(ratio(v - F.col("_mean"), F.col("_sd"))))
    return out.where(F.col("score") > limit).drop("_mean", "_sd")


def modified_zscore_rows(df: DataFrame, value: str, keys: Sequence[str] = (), limit: float = 3.5) -> DataFrame:
    """Rows far from the median in units of the median absolute deviation.

    Without any deviation there are no outliers.
    """
    out = attach_written(known(df, [*keys, value]), median_deviation(df, value, keys), keys)
    out = out.withColumn("score", F.abs(ratio(0.6745 * (F.col(value) - F.col("median")), F.col("mad"))))
    return out.where(F.col("score") > limit).drop("median", "mad")


def flagged(df: DataFrame, value: str, keys: Sequence[str] = (), forest: DataFrame | None = None, row_id: str | Sequence[str] | None = None) -> DataFrame:
    """Rows hit by any method with the list of methods.

    `forest` optionally carries `row_id`s (one column or several) that isolation trees flagged.
    """
    v = F.col(value)
    zero = F.coalesce(v, F.lit(0.0))
    # One scan for both methods: the distinct values with their counts, missing ones included.
    state = materialize(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")), "counts")
    sd = F.when(F.col("max") > F.col("min"), F.sqrt(F.col("m2") / F.col("count"))).otherwise(0.0)
    stats = moments_of(state.withColumn(value, zero), value, keys).select(*keys, F.col("mean").alias("_mean"), sd.alias("_sd"))
    q = quantiles_of(known(state, [*keys, value]), value, {"q1": 0.25, "q3": 0.75}, keys)
    out = attach_written(df, attach(stats, _fences(q, keys), keys), keys)
    methods = [
        F.when((v < F.col("low")) | (v > F.col("high")), "IQR"),
        F.when(F.abs(ratio(zero - F.col("_mean"), F.col("_sd"))) > 3, "Z-Score"),
    ]
    if forest is not None:
        ids = [row_id] if isinstance(row_id, str) else list(row_id)
        out = out.join(forest.select(*ids, F.lit(True).alias("_iso")), ids, "left")
        methods.append(F.when(F.col("_iso"), "Isolation_Forest"))
    out = out.withColumn("detection_methods", F.array_compact(F.array(*methods)))
    return out.where(F.size("detection_methods") > 0).select(*df.columns, "detection_methods")


def series_anomalies(df: DataFrame, keys: Sequence[str] = (), date="Date", value="Inventory_Level", patterns: DataFrame | None = None) -> DataFrame:
    """One anomaly per day, preferring z-score over fence over pattern.

    `patterns` optionally brings (keys, date, value, score) found by trees.
    """
    ids = [*keys, date, value]
    z = zscore_rows(df, value, keys).select(*ids, F.col("score"), F.lit(1).alias("_p"), F.lit("Statistical_Outlier").alias("kind"))
    mid = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("_med"), F.stddev(value).alias("_sd"))
    f = attach(fence_rows(df, value, keys), mid, keys)
    f = f.select(*ids, F.abs(ratio(F.col(value) - F.col("_med"), F.col("_sd"))).alias("score"), F.lit(2).alias("_p"), F.lit("IQR_Outlier").alias("kind"))
    found = z.unionByName(f)
    if patterns is not None:
        found = found.unionByName(patterns.select(*ids, "score", F.lit(3).alias("_p"), F.lit("Pattern_Anomaly").alias("kind")))
    best = found.groupBy(*keys, date).agg(F.min_by(F.struct(value, "kind", "score"), "_p").alias("_b"))
    return best.select(*keys, date, "_b.*")


FEATURE_COLUMNS = ["Inventory_Level", "DayOfYear", "Month", "Quarter", "Rolling_Mean_7", "Rolling_Std_7", "Rolling_Mean_30", "Inventory_Lag1", "Inventory_Lag7"]


def anomaly_features(df: DataFrame, keys: Sequence[str] = (), date="Date", value="Inventory_Level") -> DataFrame:
    """Calendar, rolling and lag features, filled backward then forward, standardised."""
    r7, r30 = S.rolling(keys, date, value, 7), S.rolling(keys, date, value, 30)
    w = over(keys, date)
    out = df.select(
        *keys, date, F.col(value).alias("Inventory_Level"), F.dayofyear(date).alias("DayOfYear"), F.month(date).alias("Month"),
        F.quarter(date).alias("Quarter"), r7["rolling_mean_7"].alias("Rolling_Mean_7"), r7["rolling_std_7"].alias("Rolling_Std_7"),
        r30["rolling_mean_30"].alias("Rolling_Mean_30"), F.lag(value, 1).over(w).alias("Inventory_Lag1"), F.lag(value, 7).over(w).alias("Inventory_Lag7"))
    out = S.fill(S.fill(out, keys, date, FEATURE_COLUMNS, forward=False), keys, date, FEATURE_COLUMNS, backward=False)
    stats = out.groupBy(*keys).agg(
        *[F.avg(c).alias(f"{c}_m") for c in FEATURE_COLUMNS], *[F.stddev_pop(c).alias(f"{c}_s") for c in FEATURE_COLUMNS])
    scaled = attach(out, stats, keys)
    return scaled.select(*keys, date, *[
        ((F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") > 0, F.col(f"{c}_s")).otherwise(1.0)).alias(c) for c in FEATURE_COLUMNS])


def severity(value, high: float = 0.5, medium: float = 0.2):
    return F.when(value > high, "High").when(value > medium, "Medium").otherwise("Low")


def summary(outliers: DataFrame, drift: DataFrame, shifts: DataFrame) -> DataFrame:
    """Outlier count with drift and scale severity.

    `drift` has a divergence `js`, `shifts` a `ratio`; empty inputs count as none.
    """
    n = outliers.agg(F.count(F.lit(1)).alias("total_outliers"))
    d = drift.agg(severity(F.coalesce(F.max("js"), F.lit(0.0))).alias("drift_severity"))
    s = shifts.agg(severity(F.coalesce(F.max(F.abs(1 - F.col("ratio"))), F.lit(0.0))).alias("scale_severity"))
    return attach(attach(n, d), s)


def score_bands(anomalies: DataFrame) -> DataFrame:
    s = F.col("score")
    return anomalies.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s > 5).alias("high"),
        F.count_if((s > 3) & (s <= 5)).alias("medium"), F.count_if(s <= 3).alias("low"))


def isolated(rows: DataFrame) -> DataFrame:
    """dataset, column and row of the tenth that trees of its own isolate most in each dataset and column."""
    from stocktide.models.isolation import isolation_by_key

    keys = ["dataset", "column"]
    return isolation_by_key(rows, keys, "row", "value").select(*keys, "row")


def flagged_datasets(stock: DataFrame, flows: DataFrame, sample="period", first="train", second="tune", trees: bool = True) -> DataFrame:
    """Flagged levels, quantities and values of two periods.

    `flows` carries flow, sample, Row_Id, Date, Quantity, Total_GIK. The measures
    become long rows keyed by dataset and column. Without `trees` the isolation
    trees, the third method, are left out.
    """
    name = lambda kind: F.concat_ws("_", F.col(sample), kind)
    level = stock.where(F.col(sample).isin(first, second)).select(
        name(F.lit("inventory")).alias("dataset"), F.lit("Inventory_Level").alias("column"),
        F.col("Date").cast("string").alias("row"), "Date", F.col("Inventory_Level").alias("value"))
    moved = flows.where(F.col(sample).isin(first, second)).select(
        name(F.col("flow")).alias("dataset"), F.col("Row_Id").alias("row"), "Date", "Quantity", "Total_GIK"
    ).unpivot(["dataset", "row", "Date"], ["Quantity", "Total_GIK"], "column", "value")
    quantity = (F.col("column") == "Quantity") & (F.col("dataset") != f"{first}_outflows")
    worth = (F.col("column") == "Total_GIK") & F.col("dataset").endswith("inflows")
    rows = level.unionByName(moved.where(quantity | worth))
    if not trees:
        return flagged(rows, "value", ["dataset", "column"])
    rows = materialize(rows, "measured")  # read for each dataset and column
    return flagged(rows, "value", ["dataset", "column"], isolated(rows), ["dataset", "column", "row"])


def period_shifts(stock: DataFrame, flows: DataFrame, sample="period", first="train", second="tune") -> DataFrame:
    """Ratios second / first of level mean, level deviation and inflow quantity."""
    from .drift import samples

    def ratios(df, value, *measures):
        at = {n: F.when(c, F.col(value)) for n, c in samples(sample, first, second).items()}
        rows = [F.struct(F.lit(n).alias("measure"), F.coalesce(ratio(f(at["n2"]), f(at["n1"])), F.lit(1.0)).alias("ratio")) for n, f in measures]
        return df.agg(F.array(*rows).alias("_m")).select(F.inline("_m"))

    inflows = flows.where(F.col("flow") == "inflows")
    return ratios(stock, "Inventory_Level", ("inventory_mean", F.avg), ("inventory_std", F.stddev)).unionByName(
        ratios(inflows, "Quantity", ("inflow_quantity", F.avg)))


def detect(stock: DataFrame, flows: DataFrame, sample="period", first="train", second="tune", trees: bool = True) -> dict[str, DataFrame]:
    """Full run: flagged rows, drift report, scale shifts and their summary; without `trees` rows flagged by two methods of three."""
    from .drift import drift_report

    # Both are read by the summary and by the caller.
    outliers = materialize(flagged_datasets(stock, flows, sample, first, second, trees), "flagged")
    drift = materialize(drift_report(stock, flows.where(F.col("flow") == "inflows"), sample, first, second), "drift")
    shifts = period_shifts(stock, flows, sample, first, second)
    return {"outliers": outliers, "drift": drift, "shifts": shifts,
            "summary": summary(outliers, drift.where(F.col("js").isNotNull()), shifts)}


def detection_rows(found: dict[str, DataFrame]) -> DataFrame:
    """A full run as rows (section, subject, value): flagged rows by dataset, column and methods, drift, shifts, total."""
    row = lambda df, section, subject, value: df.select(
        F.lit(section).alias("section"), subject.alias("subject"), value.cast("double").alias("value"))
    methods = found["outliers"].groupBy("dataset", "column", F.concat_ws(",", "detection_methods").alias("methods")).agg(F.count(F.lit(1)).alias("n"))
    drift = found["drift"]
    return row(methods, "outliers", F.concat_ws("|", "dataset", "column", "methods"), F.col("n")).unionByName(
        row(drift.where(F.col("js").isNotNull()), "drift", F.col("subject"), F.col("js"))).unionByName(
        row(drift.where(F.col("js").isNull()), "label_drift", F.col("subject"), F.col("total_variation"))).unionByName(
        row(found["shifts"], "shift", F.col("measure"), F.col("ratio"))).unionByName(
        row(found["summary"], "summary", F.lit("total_outliers"), F.col("total_outliers")))
