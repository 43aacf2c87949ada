"""Exact ranks of crowded values: buckets are split by measured counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stocktide.operators import aggregates as A
from stocktide.operators import drift as R
from stocktide.operators import quality as Q
from stocktide.operators import ranks


def crowded(seed=4):
    """Epoch milliseconds of one afternoon, with clusters at every scale around one of them."""
    rng = random.Random(seed)
    base = 1_700_000_000_000
    near = [base + 7 + 2.0 ** -k for k in range(8)]
    return [float(base + rng.randrange(10_000_000)) for _ in range(3000)] + near + [float(base + k) for k in range(500)] * 3 + [-5.0, 0.0, 3.5]


def test_no_bucket_holds_more_than_asked(spark):
    df = spark.createDataFrame([(v,) for v in crowded()], "v double")
    counts = ranks.counted(df, "v")
    cells, names = ranks.bucketed(counts, "v", most=40)
    assert len(names) > 2
    sizes = cells.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy(*names).collect()
    assert max(r.n for r in sizes) <= 40
    assert all(a.hi < b.lo for a, b in zip(sizes, sizes[1:]))  # buckets follow the values
    assert cells.count() == counts.count()


def test_a_million_close_values_spread_over_buckets(spark):
    df = spark.range(1_000_000).select((F.lit(1_700_000_000_000) + F.col("id")).cast("double").alias("v"))
    cells, names = ranks.bucketed(ranks.counted(df, "v"), "v", most=50_000)
    sizes = cells.groupBy(*names).count()
    assert sizes.agg(F.max("count")).first()[0] <= 50_000 and sizes.count() >= 20


def test_equal_doubles_do_not_split_for_ever(spark):
    df = spark.range(100).select((F.lit(1 << 60) + F.col("id")).alias("v"))  # distinct integers, one double
    cells, names = ranks.bucketed(ranks.counted(df, "v"), "v", most=10)
    assert cells.count() == 100


@pytest.mark.parametrize("most", [40, 1 << 20])
def test_quantiles_moments_and_deviations_of_crowded_values(spark, monkeypatch, most):
    monkeypatch.setattr(ranks, "MOST", most)
    values = crowded()
    rows = [("a", v) for v in values] + [("b", v + 1) for v in values[:700]] + [("b", None), ("c", 2.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in ranks.quantiles(df, "v", {"q": 0.25, "m": 0.5, "t": 0.999}, ["k"]).collect()}
    dev = {r.k: r for r in ranks.median_deviation(df, "v", ["k"]).collect()}
    for k in "abc":
        v = np.array([x for i, x in rows if i == k and x is not None])
        assert [got[k].q, got[k].m, got[k].t] == pytest.approx(np.quantile(v, [0.25, 0.5, 0.999]).tolist(), rel=1e-15)
        assert dev[k].median == pytest.approx(np.median(v), rel=1e-15) and dev[k].mad == pytest.approx(np.median(np.abs(v - np.median(v))), rel=1e-12, abs=1e-9)
    stats = R.rank_statistics(df.where("k != 'c'"), "v", "k", "a", "b").first()
    a, b = (np.array([x for i, x in rows if i == k and x is not None]) for k in "ab")
    grid = np.unique(np.concatenate([a, b]))
    gap = np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b))
    assert stats.ks == pytest.approx(gap.max(), rel=1e-12)
    assert stats.wasserstein == pytest.approx((gap[:-1] * np.diff(grid)).sum(), rel=1e-9)
    assert stats.u1 == pytest.approx(sum((x > b).sum() + (x == b).sum() / 2 for x in a))


def test_shapes_keep_their_digits_on_large_values(spark):
    values = [1e9 + x for x in (0.0, 1.0, 1.0, 2.0, 4.0, 4.0, 4.0, 7.0)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 0.1)] * 20 + [("c", 3.0)], "k string, v double")
    got = {r.k: r for r in A.distribution(df, "v", ["k"]).collect()}
    v = np.array(values) - 1e9
    d = v - v.mean()
    n = len(v)
    g1 = (d ** 3).mean() / (d ** 2).mean() ** 1.5
    assert got["a"].std == pytest.approx(v.std(ddof=1), rel=1e-9) and got["a"].skewness == pytest.approx(g1 * np.sqrt(n * (n - 1)) / (n - 2), rel=1e-6)
    assert got["b"].std == 0 and got["b"].skewness is None and got["c"].std is None and got["c"]["count"] == 1
    described = {r.column: r for r in Q.describe(df).collect()}
    assert described["v"]["count"] == 29


def test_outlier_counts_weigh_equal_values(spark):
    values = [1.0] * 30 + [2.0] * 30 + [50.0] * 2
    r = Q.outlier_counts(spark.createDataFrame([(v,) for v in values], "v double"), ["v"]).first()
    assert (r.iqr, r.zscore, r.modified_zscore, r.total) == (2, 2, 2, 2) and r.percentage == pytest.approx(200 / 62)
