"""Exact ranks, cumulative counts and quantiles without one global sort.

Rows collapse to distinct values with counts (combined before the shuffle, so a
value that repeats a billion times is one row), written once: quantiles, moments,
bins and two-sample statistics are all read from that table and the facts are
scanned once. Values then fall into ordered buckets; a bucket that holds more
distinct values than one task should rank is split between its least and its
largest value, again and again until none does. A running sum inside each bucket
plus the totals of the buckets below gives the global position. Every step depends
only on the data, so a task that reruns after an executor loss produces the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktide.session import materialize

from .frames import attach, known, long_form, over, ratio

Spot = Callable[[Column], Column]

# Logarithmic grid: about 0.05 % of the value per bucket, finer near zero.
_UNIT, _STEPS = 1000.0, 2048.0
MOST = 1 << 20  # distinct values that are ranked in one task


def bucket_of(value: str) -> Column:
    """A non-decreasing function of the value, never null.

    A nullable key would draw a null filter into one of the two plans that read
    the counts, and Spark would then scan twice instead of reusing the shuffle.
    """
    v = F.col(value).cast("double")
    return F.coalesce(F.floor(F.signum(v) * F.log1p(F.abs(v) * _UNIT) * _STEPS), F.lit(0))


def value_counts(df: DataFrame, value: str, keys: Sequence[str] = (), samples: dict[str, Column] | None = None):
    """Distinct non-null values with a count per sample condition (default `n`)."""
    samples = samples or {"n": F.lit(True)}
    counted = [F.count_if(cond).alias(name) for name, cond in samples.items()]
    return known(df, [*keys, value]).groupBy(*keys, value).agg(*counted)


def counted(df: DataFrame, value: str, keys: Sequence[str] = (), samples: dict[str, Column] | None = None) -> DataFrame:
    """The written value counts: one scan of the data, whatever is asked of them later."""
    return materialize(value_counts(df, value, keys, samples), "counts")


def bucketed(counts: DataFrame, value: str, keys: Sequence[str] = (), most: int | None = None) -> tuple[DataFrame, list[str]]:
    """Written counts with bucket columns, in whose order the values rise; no bucket holds more than `most` values.

    The first column is a fixed grid. Where a bucket is too full, the next one cuts it into equal
    widths; crowded values take several rounds. Sizes are measured on the written table.
    """
    most = most or MOST
    cells, names = counts.withColumn("_b0", bucket_of(value)), ["_b0"]
    if counts.count() <= most:  # from the file footers
        return cells, names
    v = F.col(value).cast("double")
    while True:
        ids = [*keys, *names]
        sizes = cells.groupBy(*ids).agg(F.count(F.lit(1)).alias("_held"), F.min(v).alias("_least"), F.max(v).alias("_largest"))
        full = sizes.where((F.col("_held") > most) & (F.col("_largest") > F.col("_least")))
        if full.isEmpty():
            return cells, names
        full = materialize(full, "full_buckets")
        parts = F.ceil(F.col("_held") / most) * 4
        place = F.least(F.floor((v - F.col("_least")) / (F.col("_largest") - F.col("_least")) * parts), parts - 1)
        held, new = cells.columns, f"_b{len(names)}"
        cells = cells.join(full, ids, "left").select(*held, F.coalesce(place, F.lit(0)).alias(new))
        names.append(new)


def cumulative(counts: DataFrame, value: str, sums: Sequence[str], keys: Sequence[str] = (), next_value=False):
    """Add `cum_<s>` (inclusive) and `all_<s>` for every count column of the written `counts`.

    With `next_value` also add the following distinct value of the key.
    """
    keys = list(keys)
    cells, names = bucketed(counts, value, keys)
    inside = Window.partitionBy(*keys, *names).orderBy(value)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cells.select("*", *[F.sum(s).over(running).alias(f"_run_{s}") for s in sums])
    if next_value:
        run = run.withColumn("_next", F.lead(value).over(inside))
    # One row per occupied bucket.
    totals = cells.groupBy(*keys, *names).agg(
        F.min(value).alias("_low"), *[F.sum(s).alias(f"_tot_{s}") for s in sums]
    )
    below = over(keys, *names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, *names,
        F.lead("_low").over(over(keys, *names)).alias("_next_low"),
        *[F.coalesce(F.sum(f"_tot_{s}").over(below), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_tot_{s}").over(over(keys)).alias(f"all_{s}") for s in sums],
    )
    joined = run.join(offsets, [*keys, *names])
    out = [*counts.columns]
    out += [(F.col(f"_run_{s}") + F.col(f"_off_{s}")).alias(f"cum_{s}") for s in sums]
    out += [f"all_{s}" for s in sums]
    if next_value:
        out.append(F.coalesce("_next", "_next_low").alias("next_value"))
    return joined.select(*out)


def positions(counts: DataFrame, value: str, spots: dict[str, Spot], keys: Sequence[str] = ()) -> DataFrame:
    """Values at 0-based positions of the sorted column, one row per key, and `all_n`, from written counts.

    A spot maps the row count to a position. The totals of the buckets name those that
    hold a wanted position (at most one per spot and key); only they are ranked.
    """
    keys, n = list(keys), F.col("all_n")
    cells, names = bucketed(counts, value, keys)
    sizes = cells.groupBy(*keys, *names).agg(F.sum("n").alias("_size"))
    below = over(keys, *names).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *keys, *names, "_size", F.coalesce(F.sum("_size").over(below), F.lit(0)).alias("_off"),
        F.sum("_size").over(over(keys)).alias("all_n"))
    holds = [(at(n) >= F.col("_off")) & (at(n) < F.col("_off") + F.col("_size")) for at in spots.values()]
    wanted = sizes.where(reduce(or_, holds)).select(*keys, *names, "_off", "all_n")
    running = Window.partitionBy(*keys, *names).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.join(wanted, [*keys, *names]).withColumn("cum_n", F.sum("n").over(running) + F.col("_off"))
    v = F.col(value).cast("double")
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    picks = [F.max(F.when((first <= at(n)) & (at(n) <= last), v)).alias(name) for name, at in spots.items()]
    return ranked.groupBy(*keys).agg(*picks, F.max("all_n").alias("all_n"))


def quantiles_of(counts: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles from written counts, one row per key, one column per name."""
    place = lambda p: lambda n: F.lit(float(p)) * (n - 1)
    spots: dict[str, Spot] = {}
    for name, p in probs.items():
        spots[f"{name}_lo"] = lambda n, p=p: F.floor(place(p)(n))
        spots[f"{name}_hi"] = lambda n, p=p: F.ceil(place(p)(n))
    found = positions(counts, value, spots, keys)
    share = lambda p: place(p)(F.col("all_n")) - F.floor(place(p)(F.col("all_n")))
    picks = [
        (F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * share(p)).alias(name) for name, p in probs.items()]
    return found.select(*keys, *picks)


def quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    return quantiles_of(counted(df, value, keys), value, probs, keys)


def moments_of(counts: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """count, mean, min, max and the sums of squared, cubed and fourth powers of deviations (m2, m3, m4) from written counts.

    The mean is known before deviations are summed, so large values with a small spread lose no digits.
    """
    v, n = F.col(value).cast("double"), F.col("n").cast("double")
    base = counts.groupBy(*keys).agg(F.sum("n").alias("count"), (F.sum(v * n) / F.sum(n)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    d = v - F.col("_mean")
    rows = attach(counts, base.select(*keys, F.col("mean").alias("_mean")), keys)
    sums = rows.groupBy(*keys).agg(*[F.sum(n * F.pow(d, F.lit(float(k)))).alias(f"m{k}") for k in (2, 3, 4)])
    return attach(base, sums, keys)


def shape_columns() -> list[Column]:
    """count, mean, std, var, min, max, range, bias-corrected shape and cv of `moments_of`.

    A derived shape is missing where a sample is too small or has no spread.
    """
    n, m2, spread = F.col("count").cast("double"), F.col("m2"), F.col("max") > F.col("min")
    var = F.when(n > 1, F.when(spread, m2 / (n - 1)).otherwise(0.0))
    g1 = F.when(spread, F.col("m3") / n / F.pow(m2 / n, F.lit(1.5)))
    g2 = F.when(spread, n * F.col("m4") / (m2 * m2) - 3)
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurt = F.when(n > 3, ratio(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return [
        F.col("count"), F.col("mean"), F.sqrt(var).alias("std"), var.alias("var"), F.col("min"), F.col("max"),
        (F.col("max") - F.col("min")).alias("range"), skew.alias("skewness"), kurt.alias("kurtosis"),
        ratio(F.sqrt(var), F.col("mean"), 0.0).alias("cv")]


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Quantiles of several columns in one pass, named `<column>_<name>`."""
    keys = list(keys)
    long = long_form(df, keys, list(columns))
    per = quantiles(long, "value", probs, [*keys, "column"])
    picks = [F.max(F.when(F.col("column") == c, F.col(n))).alias(f"{c}_{n}") for c in columns for n in probs]
    return per.groupBy(*keys).agg(*picks)


def order_statistics(df: DataFrame, value: str, limits: tuple[float, float], keys: Sequence[str] = ()) -> DataFrame:
    """Values left at each end once floor(limit * n) rows are cut off."""
    spots = {
        "low": lambda n: F.floor(F.lit(limits[0]) * n),
        "high": lambda n: n - 1 - F.floor(F.lit(limits[1]) * n),
    }
    return positions(counted(df, value, keys), value, spots, keys).select(*keys, "low", "high")


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Position of each row in sorted order, from 1; `order` ends in a unique column.

    Rows are range-partitioned and numbered slice by slice; the sliced table is
    written once, so the slice sizes and the positions agree on any rerun.
    """
    sliced = materialize(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()), "slices")
    inside = F.row_number().over(over(["_slice"], *order))
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    below = over([], "_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_off"))
    placed = sliced.withColumn("_i", inside).join(F.broadcast(offsets), "_slice")  # one row per slice
    return placed.select(*df.columns, (F.col("_i") + F.col("_off")).alias(name))


def ordered_codes(labels: DataFrame, label: str, name: str) -> DataFrame:
    """Position of each distinct label in sorted order, from 0."""
    return numbered(labels.select(label), [label], "_at").select(label, (F.col("_at") - 1).alias(name))


def median_deviation_of(counts: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Median and median absolute deviation per key, from written counts."""
    keys = list(keys)
    center = materialize(quantiles_of(counts, value, {"median": 0.5}, keys), "medians") if keys else quantiles_of(counts, value, {"median": 0.5})
    away = attach(counts, center, keys).groupBy(*keys, F.abs(F.col(value) - F.col("median")).alias("_dev")).agg(F.sum("n").alias("n"))
    spread = quantiles_of(materialize(away, "deviations"), "_dev", {"mad": 0.5}, keys)
    return center.join(spread, keys) if keys else attach(center, spread)


def median_deviation(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return median_deviation_of(counted(df, value, keys), value, keys)
