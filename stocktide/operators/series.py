"""Daily series: calendars, filling, lags, trends, decomposition.

Inputs hold at most one row per key and day, so a window over one key is
bounded by the calendar, whatever the size of the facts behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktide.session import materialize

from .frames import attach, known, over, ratio


def _so_far(keys, date):
    return over(keys, date).rowsBetween(Window.unboundedPreceding, 0)


def _from_here(keys, date):
    """The rest of the series, read backwards so that a running frame suffices."""
    return over(keys, F.desc(date)).rowsBetween(Window.unboundedPreceding, 0)


def keep_last(df: DataFrame, keys: Sequence[str], date: str, order: Sequence[str]) -> DataFrame:
    """One row per key and day: the one that arrived last.

    An aggregate with map-side combine instead of a ranked window, so a day
    holding most of the rows does not land in one task.
    """
    group = [*keys, date]
    rest = [c for c in df.columns if c not in group]
    kept = df.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return kept.select(*group, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def spine(df: DataFrame, keys: Sequence[str], date: str, step: str = "1 day") -> DataFrame:
    """Every calendar step between first and last date of each key."""
    ends = known(df, [date]).groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    days = F.sequence("_a", "_b", F.expr(f"interval {step}"))
    return ends.select(*keys, F.explode(days).alias(date))


def on_calendar(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Every day between first and last date of each key, with the row of that day where there is one.

    Each row brings the empty days up to its successor, so the series is read once and joined with nothing.
    """
    rest = [c for c in df.columns if c not in keys and c != date]
    upto = F.greatest(F.col(date), F.date_sub(F.lead(date).over(over(keys, date)), 1))
    held = known(df, [date]).withColumn("_days", F.sequence(F.col(date), upto, F.expr("interval 1 day")))
    days = held.select(*df.columns, F.posexplode("_days").alias("_at", "_day"))
    own = [F.when(F.col("_at") == 0, F.col(c)).alias(c) for c in rest]
    return days.select(*keys, F.col("_day").alias(date), *own)


def fill(df: DataFrame, keys, date: str, columns: Sequence[str], forward=True, backward=True) -> DataFrame:
    """Carry the last known value forward, then the first known one backward."""
    before, after = _so_far(keys, date), _from_here(keys, date)
    filled = {}
    for c in columns:
        v = F.last(c, ignorenulls=True).over(before) if forward else F.col(c)
        filled[c] = F.coalesce(v, F.last(c, ignorenulls=True).over(after)) if backward else v
    return df.withColumns(filled)


def interpolate(df: DataFrame, keys, date: str, column: str, by: str = "position") -> DataFrame:
    """Straight line between known neighbours; trailing gaps keep the last value.

    by="position" counts rows, by="time" counts days. Leading gaps stay missing.
    """
    w = over(keys, date)
    before, after = _so_far(keys, date), _from_here(keys, date)
    at = F.row_number().over(w) if by == "position" else F.datediff(date, F.lit("1970-01-01").cast("date"))
    df = df.withColumn("_at", at.cast("double"))
    seen = F.when(F.col(column).isNotNull(), F.struct(F.col("_at").alias("x"), F.col(column).cast("double").alias("y")))
    df = df.withColumn("_p", F.last(seen, ignorenulls=True).over(before)).withColumn(
        "_n", F.last(seen, ignorenulls=True).over(after))
    share = ratio(F.col("_at") - F.col("_p.x"), F.col("_n.x") - F.col("_p.x"), 0.0)
    line = F.col("_p.y") + (F.col("_n.y") - F.col("_p.y")) * share
    return df.withColumn(column, F.coalesce(F.col(column), line, F.col("_p.y"))).drop("_at", "_p", "_n")


def fill_gaps(df: DataFrame, keys, date: str, columns: Sequence[str], method: str = "ffill") -> DataFrame:
    """Complete the calendar and fill with ffill, bfill, interpolate or zero."""
    full = on_calendar(df, keys, date)
    if method == "zero":
        return full.na.fill(0.0, list(columns))
    if method == "interpolate":
        for c in columns:
            full = interpolate(full, keys, date, c)
        return full
    return fill(full, keys, date, columns, forward=method == "ffill", backward=method == "bfill")


def fill_methods(df: DataFrame, keys, date: str, columns: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """`fill_gaps` by several methods on one calendar, told apart by `method`."""
    full = on_calendar(df, keys, date)
    before, after = _so_far(keys, date), _from_here(keys, date)
    carried = {"ffill": before, "bfill": after}
    line = full
    if "interpolate" in methods:
        for c in columns:
            line = interpolate(line.withColumn(f"_raw_{c}", F.col(c)), keys, date, c).withColumnsRenamed({c: f"_line_{c}", f"_raw_{c}": c})

    def value(method, c):
        if method in carried:
            return F.last(c, ignorenulls=True).over(carried[method])
        return F.coalesce(c, F.lit(0.0)) if method == "zero" else F.col(f"_line_{c}")

    made = {f"_{m}_{c}": value(m, c) for m in methods for c in columns}
    rows = [F.struct(F.lit(m).alias("method"), *[F.col(f"_{m}_{c}").alias(c) for c in columns]) for m in methods]
    return line.withColumns(made).select(*keys, date, F.inline(F.array(*rows)))


def model_frame(df: DataFrame, keys=(), date="Date", value="Inventory_Level", order=None, backfill=True) -> DataFrame:
    """Columns keys, ds, y on a complete calendar."""
    base = df.select(*keys, F.col(date).alias("ds"), F.col(value).cast("double").alias("y"), *(order or []))
    if order:
        base = keep_last(base, keys, "ds", order).drop(*order)
    return fill(on_calendar(base, keys, "ds"), keys, "ds", ["y"], backward=backfill)


FEATURES = [
    "Total_Daily_Inflows", "Total_Daily_Outflows", "Active_Warehouses", "Warehouse_Diversity",
    "Total_Category_Inflows", "Total_Category_Outflows", "Active_Categories", "Category_Diversity",
]


def with_flow_features(frame: DataFrame, *features: DataFrame) -> DataFrame:
    """Left-join daily flow features on ds; days without flows count as zero."""
    for f in features:
        cols = [c for c in FEATURES if c in f.columns]
        frame = frame.join(f.select(F.col("Date").alias("ds"), *cols), "ds", "left").na.fill(0.0, cols)
    return frame


def lags(df: DataFrame, keys, date: str, value: str, steps=(1, 7, 30), prefix="lag_") -> DataFrame:
    w = over(keys, date)
    return df.withColumns({f"{prefix}{k}": F.lag(value, k).over(w) for k in steps})


def rolling(keys, date: str, value: str, window: int, min_periods: int | None = None) -> dict[str, Column]:
    """Trailing mean, std, max and min over `window` rows."""
    w = over(keys, date).rowsBetween(-(window - 1), 0)
    need = window if min_periods is None else min_periods
    enough = F.count(value).over(w) >= need
    stats = {"mean": F.avg, "std": F.stddev, "max": F.max, "min": F.min}
    return {f"rolling_{n}_{window}": F.when(enough, f(value).over(w)) for n, f in stats.items()}


def calendar_columns(date: str) -> dict[str, Column]:
    d = F.col(date)
    return {
        "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "quarter": F.quarter(d),
        "dayofweek": F.weekday(d), "dayofyear": F.dayofyear(d), "weekofyear": F.weekofyear(d),
        "dayname": F.date_format(d, "EEEE"),
    }


def changes(df: DataFrame, keys, date: str, value: str) -> DataFrame:
    """Difference to the row before, and relative change of the padded value."""
    w = over(keys, date)
    padded = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_v", padded)
    prev = F.lag("_v").over(w)
    return df.withColumn("diff", F.col(value) - F.lag(value).over(w)).withColumn(
        "pct_change", ratio(F.col("_v"), prev) - 1).drop("_v")


def change_profile(df: DataFrame, keys, date: str, value: str) -> DataFrame:
    return changes(df, keys, date, value).groupBy(*keys).agg(
        F.stddev("pct_change").alias("daily_volatility"),
        F.max(F.abs("pct_change")).alias("max_daily_change"),
        F.avg("pct_change").alias("avg_daily_change"),
    )


def turning_points(df: DataFrame, keys, date: str, value: str, window: int = 30) -> DataFrame:
    """Rows whose value equals the trailing extreme of a full window."""
    r = rolling(keys, date, value, window)
    top, low = r[f"rolling_max_{window}"], r[f"rolling_min_{window}"]
    tagged = df.withColumn("_top", top).withColumn("_low", low)
    kinds = F.array_compact(F.array(
        F.when(F.col(value) == F.col("_top"), "peak"), F.when(F.col(value) == F.col("_low"), "trough")))
    return tagged.select(*keys, date, value, F.explode(kinds).alias("kind"))


def growth_between_ends(df: DataFrame, keys, date: str, value: str, n: int = 30) -> DataFrame:
    """Mean of the first and last n rows; growth is flagged above one half."""
    ranked = df.select(
        *keys, value,
        F.row_number().over(over(keys, F.asc(date))).alias("_a"), F.row_number().over(over(keys, F.desc(date))).alias("_d"),
    )
    out = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.when(F.col("_a") <= n, F.col(value))).alias("early_avg"),
        F.avg(F.when(F.col("_d") <= n, F.col(value))).alias("recent_avg"),
    ).where(F.col("rows") > n)
    grown = F.when(F.col("early_avg") > 0, ratio(F.col("recent_avg") - F.col("early_avg"), F.col("early_avg")))
    return out.withColumn("growth", grown).withColumn("rapid", F.coalesce(F.col("growth") > 0.5, F.lit(False)))


def positional_split(df: DataFrame, keys, date: str, parts: int = 3) -> DataFrame:
    """Consecutive parts of equal length, the remainder in the last one."""
    w = over(keys, date)
    size = F.greatest(F.floor(F.count(F.lit(1)).over(over(keys)) / parts), F.lit(1))
    at = F.floor((F.row_number().over(w) - 1) / size)
    return df.withColumn("part", F.least(at, F.lit(parts - 1)))


def cv_folds(df: DataFrame, keys, date: str, splits: int = 3) -> DataFrame:
    """Expanding-window folds: each row once per fold, as train or test."""
    n = F.count(F.lit(1)).over(over(keys))
    df = df.withColumn("_i", F.row_number().over(over(keys, date)) - 1).withColumn("_n", n)
    df = df.withColumn("_size", F.floor(F.col("_n") / (splits + 1)))
    df = df.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(splits)])))
    start = F.col("_n") - F.col("_size") * (splits - F.col("fold"))
    role = F.when(F.col("_i") < start, "train").when(F.col("_i") < start + F.col("_size"), "test")
    return df.withColumn("role", role).where(F.col("role").isNotNull()).drop("_i", "_n", "_size")


def resample(df: DataFrame, grain: str, date: str = "Date", columns: dict[str, str] | None = None, keys=()) -> DataFrame:
    """Sum or mean per day, week ending Sunday or month end; empty buckets appear."""
    columns = columns or {"Quantity": "sum"}
    start = F.to_date(F.date_trunc({"D": "day", "W": "week", "M": "month"}[grain], F.col(date)))
    per = df.withColumn("_b", start).groupBy(*keys, "_b").agg(
        *[(F.sum(c) if f == "sum" else F.avg(c)).alias(c) for c, f in columns.items()])
    full = spine(per, keys, "_b", {"D": "1 day", "W": "1 week", "M": "1 month"}[grain]).join(per, [*keys, "_b"], "left")
    full = full.na.fill(0.0, [c for c, f in columns.items() if f == "sum"])
    label = {"D": F.col("_b"), "W": F.date_add("_b", 6), "M": F.last_day("_b")}[grain]
    return full.select(*keys, label.alias(date), *columns)


def resample_all(df: DataFrame, grains: Sequence[str] = "DWM", date: str = "Date", columns: dict[str, str] | None = None, keys=()) -> DataFrame:
    """`resample` to several grains, told apart by `grain`; the rows are read once.

    Days are summed and counted into a written table, and every grain is merged from those sums.
    """
    columns = columns or {"Quantity": "sum"}
    sums = {c: F.sum(c).alias(c) for c in columns}
    counts = [F.count(c).alias(f"_n_{c}") for c in columns]
    states = df.groupBy(*keys, F.to_date(date).alias(date)).agg(*sums.values(), *counts)
    states = materialize(states, "days")
    out = None
    for g in grains:
        means = {c: f"_n_{c}" for c, f in columns.items() if f != "sum"}
        part = resample(states, g, date, {c: "sum" for c in states.columns if c not in keys and c != date}, keys)
        # An empty bucket has no mean: its count is zero.
        part = part.withColumns({c: ratio(c, n) for c, n in means.items()})
        part = part.select(F.lit(g).alias("grain"), *keys, date, *columns)
        out = part if out is None else out.unionByName(part)
    return out


def indexed(df: DataFrame, keys, date: str, name="_i") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(over(keys, date)) - 1).cast("double"))


def linear_trend(df: DataFrame, keys, date: str, value: str) -> DataFrame:
    """Least squares on the row index: slope, intercept, r2, n, direction."""
    x, y = F.col("_i"), F.col(value).cast("double")
    fit = indexed(df, keys, date).groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))
    return fit.where(F.col("n") >= 2).withColumn("direction", F.when(F.col("slope") > 0, "increasing").otherwise("decreasing"))


def detrend(df: DataFrame, keys, date: str, value: str) -> DataFrame:
    """Subtract the fitted line; adds `trend` and `detrended`."""
    fit = linear_trend(df, keys, date, value).select(*keys, "slope", "intercept")
    out = attach(indexed(df, keys, date), fit, keys)
    out = out.withColumn("trend", F.col("slope") * F.col("_i") + F.col("intercept"))
    return out.withColumn("detrended", F.col(value) - F.col("trend")).drop("_i", "slope", "intercept")


def decompose(df: DataFrame, keys, date: str, value: str, period: int) -> DataFrame:
    """Additive trend, seasonal and residual parts.

    The trend is the centred mean over one period (half weights at both ends
    when the period is even) and is missing near the ends.
    """
    w = over(keys, date)
    half = period // 2
    span = w.rowsBetween(-half, half)
    full = F.count(value).over(span) == 2 * half + 1
    total = F.sum(value).over(span)
    if period % 2 == 0:
        total = total - (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2
    df = indexed(df, keys, date).withColumn("trend", F.when(full, total / period))
    df = df.withColumn("_phase", F.pmod(F.col("_i").cast("long"), F.lit(period))).withColumn("_rest", F.col(value) - F.col("trend"))
    phases = df.groupBy(*keys, "_phase").agg(F.avg("_rest").alias("_m"))
    centred = phases.withColumn("seasonal", F.col("_m") - F.avg("_m").over(over(keys))).drop("_m")
    out = df.join(centred, [*keys, "_phase"], "left")
    return out.withColumn("resid", F.col("_rest") - F.col("seasonal")).drop("_phase", "_rest", "_i")


def trend_change(df: DataFrame, keys, date: str, value: str, period: int = 365, min_rows: int = 24) -> DataFrame:
    """Slope of the first against the last half of the smoothed trend; a series too short for it gets nulls and a reason."""
    parts = decompose(df, keys, date, value, period).where(F.col("trend").isNotNull())
    at = indexed(parts, keys, date).withColumn("_n", F.count(F.lit(1)).over(over(keys))).withColumn("_h", F.floor(F.col("_n") / 2))
    early = F.col("_i") < F.col("_h")
    late = F.col("_i") >= F.col("_n") - F.col("_h")
    slope = lambda cond: F.regr_slope(F.when(cond, F.col("trend")), F.col("_i"))
    out = at.groupBy(*keys).agg(
        slope(early).alias("early_slope"), slope(late).alias("late_slope"),
        F.stddev("trend").alias("_sd"), F.count(F.lit(1)).alias("_rows"))
    gap = F.abs(F.col("late_slope") - F.col("early_slope"))
    enough = F.col("_rows") + (period // 2) * 2 >= min_rows
    found = {"early_slope": F.col("early_slope"), "late_slope": F.col("late_slope"), "change": gap, "changed": gap > F.col("_sd") * 0.1}
    out = out.select(*keys, *[F.when(enough, c).alias(n) for n, c in found.items()])  # without keys always one row
    reason = F.when(F.col("early_slope").isNull(), F.lit("insufficient data")).alias("reason")
    whole = df.select(*keys).distinct().join(out, list(keys), "left") if keys else out
    return whole.select("*", reason)


def long_gaps(df: DataFrame, keys, date: str, days: int = 30) -> DataFrame:
    """Gaps of more than `days` between observed dates."""
    gap = F.datediff(F.col(date), F.lag(date).over(over(keys, date)))
    return df.select(*keys, date, gap.alias("gap_days")).where(F.col("gap_days") > days)


def detrend_if_gapped(df: DataFrame, keys, date: str, value: str, days: int = 30) -> DataFrame:
    """Linear detrending for the series that have a long gap, else untouched."""
    gaps = long_gaps(df, keys, date, days).groupBy(*keys).agg(F.count(F.lit(1)).alias("gaps"))
    out = attach(detrend(df, keys, date, value), gaps, keys)
    hit = F.coalesce(F.col("gaps"), F.lit(0)) > 0
    return out.withColumn("trend", F.when(hit, F.col("trend"))).withColumn("detrended", F.when(hit, F.col("detrended"))).drop("gaps")


def detrend_by_decomposition(df: DataFrame, keys, date: str, value: str, period: int = 365) -> DataFrame:
    """`trend` and `detrended`: the smoothed trend where a series holds two periods, carried to its ends, else a line.

    `method` says which of the two a series got. Both are worked out side by side in one plan.
    """
    smooth = fill(decompose(df, keys, date, value, period), keys, date, ["trend"], forward=False)
    smooth = fill(smooth, keys, date, ["trend"], backward=False).drop("seasonal", "resid")
    fit = linear_trend(df, keys, date, value).select(*keys, "slope", "intercept", "n")
    out = attach(indexed(smooth, keys, date), fit, keys)
    long_enough = F.coalesce(F.col("n"), F.lit(0)) >= 2 * period
    line = F.col("slope") * F.col("_i") + F.col("intercept")
    out = out.withColumn("trend", F.when(long_enough, F.col("trend")).otherwise(line)).withColumn("method", F.when(long_enough, "decomposition").otherwise("line"))
    return out.withColumn("detrended", F.col(value) - F.col("trend")).drop("_i", "slope", "intercept", "n")


def detrend_gapped(df: DataFrame, keys, date: str, value: str, days: int = 30, period: int = 365) -> DataFrame:
    """Detrending, by decomposition where possible, of the series that have a long gap; the others stay untouched."""
    gaps = long_gaps(df, keys, date, days).groupBy(*keys).agg(F.count(F.lit(1)).alias("gaps"))
    out = attach(detrend_by_decomposition(df, keys, date, value, period), gaps, keys)
    hit = F.coalesce(F.col("gaps"), F.lit(0)) > 0
    return out.withColumns({c: F.when(hit, F.col(c)) for c in ("trend", "detrended", "method")}).drop("gaps")


def seasonality(df: DataFrame, keys, date: str, value: str, min_rows: int = 30) -> DataFrame:
    """Spread of month and weekday means; seasonal above 0.1 or 0.05."""
    def spread(bucket, name):
        means = df.groupBy(*keys, bucket.alias("_b")).agg(F.avg(value).alias("_m"))
        return means.groupBy(*keys).agg(ratio(F.stddev("_m"), F.avg("_m")).alias(name))

    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    out = attach(rows, spread(F.month(date), "monthly_variation"), keys)
    out = attach(out, spread(F.weekday(F.col(date)), "weekly_variation"), keys)
    seasonal = (F.col("monthly_variation") > 0.1) | (F.col("weekly_variation") > 0.05)
    enough = F.col("rows") >= min_rows
    return out.select(
        *keys, (enough & F.coalesce(seasonal, F.lit(False))).alias("seasonal"),
        F.when(enough, F.col("monthly_variation")).alias("monthly_variation"),
        F.when(enough, F.col("weekly_variation")).alias("weekly_variation"))


def carry_into_horizon(df: DataFrame, keys, date: str, columns: Sequence[str], periods: int) -> DataFrame:
    """Extend each series by `periods` days holding the last known regressors."""
    ends = df.groupBy(*keys).agg(F.max(date).alias("_b"))
    ahead = ends.select(*keys, F.explode(F.sequence(F.date_add("_b", 1), F.date_add("_b", periods))).alias(date))
    tagged = df.select(*keys, date, *columns).withColumn("is_future", F.lit(False)).unionByName(
        ahead.withColumn("is_future", F.lit(True)), allowMissingColumns=True)
    return fill(tagged, keys, date, columns, backward=False).na.fill(0.0, list(columns))


def level_trends(df: DataFrame, keys=(), date="Date", value="Inventory_Level") -> DataFrame:
    """Level statistics, linear trend, daily volatility and month pattern spread."""
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("mean_level"), F.stddev(value).alias("std_level"), F.min(value).alias("min_level"),
        F.max(value).alias("max_level"), F.percentile(value, 0.5).alias("median_level"))
    out = attach(stats, linear_trend(df, keys, date, value), keys)
    out = attach(out, change_profile(df, keys, date, value), keys)
    months = df.groupBy(*keys, F.month(date).alias("_m")).agg(F.avg(value).alias("_v"))
    return attach(out, months.groupBy(*keys).agg(ratio(F.stddev("_v"), F.avg("_v")).alias("month_pattern_cv")), keys)


def training_features(frame: DataFrame, keys=()) -> DataFrame:
    """Calendar, lag and rolling features of a model frame; incomplete rows go."""
    cal = {k: v for k, v in calendar_columns("ds").items() if k != "dayname"}
    roll = rolling(keys, "ds", "y", 7, min_periods=1)
    out = lags(frame.withColumns(cal), keys, "ds", "y", (1, 7))
    out = out.withColumns({k: roll[k] for k in ("rolling_mean_7", "rolling_std_7")})
    return out.na.drop()
