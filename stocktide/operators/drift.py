"""Two-sample statistics and drift reports.

A frame carries both samples in one column (`sample`), so each test reads the
data once. `keys` runs the same test for many columns or series side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.functions import pvalues as P
from stocktide.session import materialize

from . import aggregates as A
from . import series as S
from .frames import attach, attach_written, known, long_form, over, ratio, with_totals
from .ranks import counted, cumulative, value_counts

EPS = 1e-10
BINS = 49


def samples(sample: str, first, second) -> dict[str, Column]:
    return {"n1": F.col(sample) == first, "n2": F.col(sample) == second}


def tag_by_date(df: DataFrame, first_before: str, second_from: str, date="Date") -> DataFrame:
    """Split by date: rows before one bound, rows from another, the rest dropped."""
    d = F.col(date)
    tag = F.when(d < F.lit(first_before).cast("date"), "first").when(d >= F.lit(second_from).cast("date"), "second")
    return df.withColumn("sample", tag).where(F.col("sample").isNotNull())


def _both(df, sample, first, second):
    return df.where(F.col(sample).isin(first, second))


def rank_statistics(df: DataFrame, value: str, sample: str, first, second, keys: Sequence[str] = ()) -> DataFrame:
    """KS distance, Mann-Whitney U1 with its tie-corrected z, Wasserstein-1.

    All three come from one table of cumulative counts over distinct values.
    """
    return rank_statistics_of(sample_counts(df, value, sample, first, second, keys), value, keys)


def sample_counts(df: DataFrame, value: str, sample: str, first, second, keys: Sequence[str] = ()) -> DataFrame:
    """Written counts (n1, n2) of the distinct values in both samples, from which every two-sample statistic is read."""
    both = _both(df, sample, first, second).withColumn(value, F.col(value).cast("double"))
    return counted(both, value, keys, samples(sample, first, second))


def rank_statistics_of(counts: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    c = cumulative(counts, value, ["n1", "n2"], keys, next_value=True)
    n1, n2 = F.col("all_n1").cast("double"), F.col("all_n2").cast("double")
    gap = F.abs(ratio(F.col("cum_n1"), n1) - ratio(F.col("cum_n2"), n2))
    ties = (F.col("n1") + F.col("n2")).cast("double")
    below = (F.col("cum_n1") + F.col("cum_n2")).cast("double") - ties
    out = c.groupBy(*keys).agg(
        F.max(gap).alias("ks"),
        F.sum(F.coalesce(gap * (F.col("next_value") - F.col(value)), F.lit(0.0))).alias("wasserstein"),
        F.sum(F.col("n1") * (below + (ties + 1) / 2)).alias("_r1"),
        F.sum(ties * ties * ties - ties).alias("_ties"),
        F.max("all_n1").alias("n1"), F.max("all_n2").alias("n2"))
    a, b = F.col("n1").cast("double"), F.col("n2").cast("double")
    u1 = F.col("_r1") - a * (a + 1) / 2
    n = a + b
    sd = F.sqrt(a * b / 12 * ((n + 1) - ratio(F.col("_ties"), n * (n - 1), 0.0)))
    # Two-sided normal approximation with continuity correction.
    z = ratio(F.greatest(u1, a * b - u1) - a * b / 2 - 0.5, sd)
    empty = (F.col("n1") == 0) | (F.col("n2") == 0)
    nothing = lambda x: F.when(empty, F.lit(0.0)).otherwise(x)
    return out.select(
        *keys, "n1", "n2", nothing(F.col("ks")).alias("ks"), nothing(F.col("wasserstein")).alias("wasserstein"),
        F.when(~empty, u1).alias("u1"), F.when(~empty, F.greatest(z, F.lit(0.0))).alias("z"))


def with_rank_p(stats: DataFrame) -> DataFrame:
    return stats.withColumn("ks_p", P.ks_p("ks", "n1", "n2")).withColumn("mw_p", P.normal_p("z"))


def binned_divergence(df: DataFrame, value: str, sample: str, first, second, keys: Sequence[str] = ()) -> DataFrame:
    """Jensen-Shannon divergence over 49 equal bins of the common range."""
    return binned_divergence_of(sample_counts(df, value, sample, first, second, keys), value, keys)


def binned_divergence_of(counts: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    edges = counts.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / BINS
    at = F.least(F.floor(ratio(F.col(value) - F.col("_lo"), width, 0.0)), F.lit(BINS - 1))
    conds = ("n1", "n2")
    bins = attach_written(counts, edges, keys).groupBy(*keys, at.alias("_bin")).agg(*[F.sum(n).cast("double").alias(n) for n in conds])
    # An empty bin adds nothing to the sums but its epsilon counts in the norm.
    norm = 1 + BINS * EPS
    shares = bins.select(*keys, *[((ratio(F.col(n), F.sum(n).over(over(keys)), 0.0) + EPS) / norm).alias(n) for n in conds])
    p, q = F.col("n1"), F.col("n2")
    m = (p + q) / 2
    js = F.sum(p * F.ln(p / m)) / 2 + F.sum(q * F.ln(q / m)) / 2
    return shares.groupBy(*keys).agg(js.alias("js"))


def label_shares(df: DataFrame, label: str, sample: str, first, second, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and shares of each label in both samples, absent labels as zero."""
    return label_shares_of(value_counts(_both(df, sample, first, second), label, keys, samples(sample, first, second)), label, keys)


def label_shares_of(counts: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    out = with_totals(counts, keys, t1=F.sum("n1"), t2=F.sum("n2"))
    return out.select(*keys, label, "n1", "n2", ratio("n1", "t1", 0.0).alias("p"), ratio("n2", "t2", 0.0).alias("q"))


def label_divergence(shares: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Jensen-Shannon divergence with epsilon inside the logarithm, and its size."""
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    js = F.sum(p * F.ln((p + EPS) / (m + EPS))) / 2 + F.sum(q * F.ln((q + EPS) / (m + EPS))) / 2
    out = shares.groupBy(*keys).agg(js.alias("js"))
    return out.withColumn("magnitude", F.when(F.col("js") > 0.3, "high").when(F.col("js") > 0.1, "medium").otherwise("low"))


def label_drift(shares: DataFrame, keys: Sequence[str] = (), on="counts") -> DataFrame:
    """Chi-square of the second sample against the first, total variation, labels.

    on="counts" expects second-sample counts in proportion to the first sample;
    on="shares" compares the proportions themselves. A label new in the second
    sample has no expectation, so it takes no part in the statistic and is
    reported among the new labels.
    """
    base = with_totals(shares, keys, _seen=F.sum(F.when(F.col("n1") > 0, F.col("n2"))))
    got, want = (F.col("n2").cast("double"), F.col("p") * F.col("_seen")) if on == "counts" else (F.col("q"), F.col("p"))
    term = F.when(F.col("n1") > 0, ratio((got - want) * (got - want), want, 0.0)).otherwise(0.0)
    return base.groupBy(*keys).agg(
        F.sum(term).alias("chi2"), (F.count_if(F.col("n1") > 0) - 1).alias("df"),
        (F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("total_variation"),
        F.count_if(F.col("n1") == 0).alias("new_labels"), F.count_if(F.col("n2") == 0).alias("gone_labels"))


def numeric_drift(df: DataFrame, value: str, sample: str, first, second, keys=()) -> DataFrame:
    """Divergence, KS distance and Wasserstein distance."""
    return numeric_drift_of(sample_counts(df, value, sample, first, second, keys), value, keys)


def numeric_drift_of(counts: DataFrame, value: str, keys=()) -> DataFrame:
    return attach(rank_statistics_of(counts, value, keys), binned_divergence_of(counts, value, keys), keys)


def drift_report(stock: DataFrame, flows: DataFrame, sample: str, first, second) -> DataFrame:
    """Numeric drift of level, quantity and value; label drift of the dimensions.

    Measures and dimensions become long rows that are counted together in one
    scan; both kinds of drift are read from the written counts.
    """
    no_label, no_value = F.lit(None).cast("string"), F.lit(None).cast("double")
    measure = lambda name, c: F.struct(F.lit(name).alias("subject"), F.col(c).cast("double").alias("value"), no_label.alias("label"))
    label = lambda c: F.struct(F.lit(c.lower()).alias("subject"), no_value.alias("value"), F.col(c).alias("label"))
    moved = [measure("quantity", "Quantity"), measure("gik", "Total_GIK"), *map(label, ("Category", "Brand", "Warehouse"))]
    rows = stock.select(sample, F.inline(F.array(measure("inventory", "Inventory_Level")))).unionByName(flows.select(sample, F.inline(F.array(*moved))))
    seen = rows.where(F.col("value").isNotNull() | F.col("label").isNotNull())
    conds = samples(sample, first, second)
    counts = materialize(_both(seen, sample, first, second).groupBy("subject", "value", "label").agg(
        *[F.count_if(c).alias(n) for n, c in conds.items()]), "counts")
    num = numeric_drift_of(counts.where("label is null").select("subject", "value", *conds), "value", ["subject"])
    num = num.select("subject", "js", "ks", "wasserstein", "u1")
    cat = label_drift(label_shares_of(counts.where("label is not null").select("subject", "label", *conds), "label", ["subject"]), ["subject"])
    cat = cat.select("subject", "chi2", "total_variation", "new_labels", "gone_labels")
    return num.unionByName(cat, allowMissingColumns=True)


def scale_shift(df: DataFrame, value: str, sample: str, first, second, keys=(), default: float = 1.0) -> DataFrame:
    """Ratios second / first of mean, std, variance, median and range."""
    both = known(_both(df, sample, first, second), [*keys, value])
    stat = both.groupBy(*keys, sample).agg(
        F.avg(value).alias("mean"), F.stddev(value).alias("std"), F.variance(value).alias("var"),
        (F.max(value) - F.min(value)).alias("range"))
    from .ranks import quantiles

    stat = stat.join(quantiles(both, value, {"median": 0.5}, [*keys, sample]), [*keys, sample])
    at = lambda s, c: F.max(F.when(F.col(sample) == s, F.col(c)))
    names = ["mean", "std", "var", "median", "range"]
    wide = stat.groupBy(*keys).agg(
        *[at(first, c).alias(f"first_{c}") for c in names], *[at(second, c).alias(f"second_{c}") for c in names])
    ratios = [F.when(F.col(f"first_{c}") == 0, F.lit(default)).otherwise(ratio(f"second_{c}", f"first_{c}")).alias(f"{c}_ratio") for c in names]
    return wide.select(*keys, "first_mean", "second_mean", "first_std", "second_std", *ratios).withColumn(
        "requires_adjustment", F.abs(F.col("mean_ratio") - 1) > 0.1)


def t_test(df: DataFrame, value: str, sample: str, first, second, keys=()) -> DataFrame:
    """Pooled two-sample t statistic and degrees of freedom."""
    at = lambda s: F.when(F.col(sample) == s, F.col(value).cast("double"))
    out = df.groupBy(*keys).agg(
        F.count(at(first)).cast("double").alias("n1"), F.count(at(second)).cast("double").alias("n2"),
        F.avg(at(first)).alias("mean1"), F.avg(at(second)).alias("mean2"),
        F.variance(at(first)).alias("var1"), F.variance(at(second)).alias("var2"))
    n1, n2 = F.col("n1"), F.col("n2")
    df_ = n1 + n2 - 2
    pooled = ratio((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2"), df_)
    se = F.sqrt(pooled * (ratio(F.lit(1.0), n1) + ratio(F.lit(1.0), n2)))
    return out.withColumn("t", ratio(F.col("mean1") - F.col("mean2"), se)).withColumn("df", df_)


def compare_distributions(df: DataFrame, value: str, sample: str, first, second) -> DataFrame:
    """Profile of each sample plus the t, U and KS statistics."""
    prof = A.distribution(_both(df, sample, first, second), value, [sample])
    tests = attach(t_test(df, value, sample, first, second).select("t", "df"),
                   rank_statistics(df, value, sample, first, second).select("u1", "ks"))
    return attach(prof, tests)


def period_comparison(df: DataFrame, value: str, sample: str, first, second) -> DataFrame:
    """Means, deviations, percent change and the t statistic of two periods."""
    return t_test(df, value, sample, first, second).select(
        F.col("mean1").alias("first_avg"), F.col("mean2").alias("second_avg"),
        F.sqrt("var1").alias("first_std"), F.sqrt("var2").alias("second_std"),
        (ratio(F.col("mean2") - F.col("mean1"), F.col("mean1")) * 100).alias("percentage_change"), "t", "df")


def trend_comparison(stock: DataFrame, sample: str, first, second, value="Inventory_Level") -> DataFrame:
    """One row: scale, trend directions, volatility, rank tests, seasonality."""
    both = _both(stock, sample, first, second)
    trend = S.linear_trend(both, [sample], "Date", value).select(sample, "slope", "r2", "direction")
    season = S.seasonality(both, [sample], "Date", value)
    per = both.groupBy(sample).agg(F.avg(value).alias("mean"), F.stddev(value).alias("std"))
    per = per.withColumn("volatility", ratio("std", "mean")).join(trend, sample).join(season, sample)
    fields = ["mean", "volatility", "slope", "r2", "direction", "seasonal"]
    at = lambda s, c: F.max(F.when(F.col(sample) == s, F.col(c)))
    wide = per.groupBy().agg(*[at(s, c).alias(f"{t}_{c}") for s, t in ((first, "first"), (second, "second")) for c in fields])
    shift = F.when(F.col("first_direction") == F.col("second_direction"), F.concat(F.lit("consistent "), "first_direction")).otherwise(
        F.concat("first_direction", F.lit(" to "), "second_direction"))
    wide = wide.select("*", ratio("second_mean", "first_mean").alias("scale_change"),
                       ratio("second_volatility", "first_volatility").alias("volatility_change"), shift.alias("trend_shift"))
    return attach(wide, rank_statistics(stock, value, sample, first, second).select("ks", "u1", "z", "n1", "n2"))


def preference_shift(shares: DataFrame) -> DataFrame:
    """Share change in points and percent; percent is missing for new labels."""
    change = F.col("q") - F.col("p")
    return shares.select("*", change.alias("change"), F.when(F.col("p") > 0, ratio(change, F.col("p")) * 100).alias("percent_change"))


def value_change(df: DataFrame, label: str, value: str, sample: str, first, second) -> DataFrame:
    """Mean value per label in two samples and its change."""
    at = lambda s: F.coalesce(F.avg(F.when(F.col(sample) == s, F.col(value))), F.lit(0.0))
    out = known(_both(df, sample, first, second), [label]).groupBy(label).agg(at(first).alias("first_avg"), at(second).alias("second_avg"))
    change = F.col("second_avg") - F.col("first_avg")
    return out.select("*", change.alias("change"), F.when(F.col("first_avg") > 0, ratio(change, F.col("first_avg")) * 100).alias("percent_change"))


def efficiency_change(df: DataFrame, label: str, sample: str, first, second) -> DataFrame:
    """Value per unit of each label in two samples."""
    total = lambda s, c: F.coalesce(F.sum(F.when(F.col(sample) == s, F.col(c))), F.lit(0.0))
    out = known(_both(df, sample, first, second), [label]).groupBy(label).agg(
        total(first, "Quantity").alias("q1"), total(second, "Quantity").alias("q2"),
        total(first, "Total_GIK").alias("v1"), total(second, "Total_GIK").alias("v2"))
    e1, e2 = ratio("v1", "q1", 0.0), ratio("v2", "q2", 0.0)
    return out.select(label, e1.alias("first_efficiency"), e2.alias("second_efficiency"), (e2 - e1).alias("efficiency_change"),
                      (F.col("q2") - F.col("q1")).alias("quantity_change"), (F.col("v2") - F.col("v1")).alias("value_change"))


def label_comparison(df: DataFrame, dims: Sequence[str], sample: str, first, second, k: int = 5) -> DataFrame:
    """Chi-square per dimension with the leading labels of either sample."""
    long = df.select(sample, *dims).unpivot([sample], list(dims), "dimension", "label")
    shares = label_shares(long, "label", sample, first, second, ["dimension"])
    drift = label_drift(shares, ["dimension"]).select("dimension", "chi2", "df")

    def leaders(count, name):
        top = A.top_labels(shares.withColumnRenamed(count, "n").where("n > 0"), "label", k, ["dimension"])
        pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "label")))
        return top.groupBy("dimension").agg(F.concat_ws(",", F.transform(pairs, lambda s: s["label"])).alias(name))

    return drift.join(leaders("n1", "first_top"), "dimension", "left").join(leaders("n2", "second_top"), "dimension", "left")
