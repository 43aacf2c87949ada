import datetime as dt

from pyspark.sql import functions as F

from stocktide.operators import aggregates as A
from stocktide.operators import combine as J
from stocktide.operators import policy as P
from stocktide.operators import profile
from stocktide.operators import series as S

GAPPY = [
    ("a", "2023-01-01", None), ("a", "2023-01-02", 10.0), ("a", "2023-01-06", 30.0), ("a", "2023-01-07", None),
    ("b", "2023-02-01", 5.0), ("b", "2023-02-03", 7.0),
]


def series(frame, rows=GAPPY):
    return frame(rows, "k string, Date date, v double")


def values(df, key, col="v"):
    return [r[col] for r in df.where(F.col("k") == key).orderBy("Date").collect()]


def test_fill_methods(frame):
    df = series(frame)
    get = lambda m, k="a": values(S.fill_gaps(df, ["k"], "Date", ["v"], m), k)
    assert get("ffill") == [None, 10, 10, 10, 10, 30, 30]
    assert get("bfill") == [10, 10, 30, 30, 30, 30, None]
    assert get("zero") == [0, 10, 0, 0, 0, 30, 0]
    assert get("interpolate") == [None, 10, 15, 20, 25, 30, 30]
    assert values(S.fill(S.on_calendar(df, ["k"], "Date"), ["k"], "Date", ["v"]), "a") == [10, 10, 10, 10, 10, 30, 30]
    assert get("interpolate", "b") == [5, 6, 7]


def test_time_interpolation_weighs_days(frame):
    df = frame([("a", "2023-01-01", 0.0), ("a", "2023-01-02", None), ("a", "2023-01-05", 8.0)], "k string, Date date, v double")
    assert values(S.interpolate(df, ["k"], "Date", "v", "time"), "a") == [0, 2, 8]
    assert values(S.interpolate(df, ["k"], "Date", "v"), "a") == [0, 4, 8]


def test_model_frame_keeps_the_last_reading(frame):
    df = frame([("2023-01-01", 1.0, 1), ("2023-01-01", 9.0, 2), ("2023-01-03", 4.0, 3)], "Date date, Inventory_Level double, seq int")
    got = [(str(r.ds), r.y) for r in S.model_frame(df, order=["seq"]).orderBy("ds").collect()]
    assert got == [("2023-01-01", 9.0), ("2023-01-02", 9.0), ("2023-01-03", 4.0)]


def test_rolling_needs_enough_rows(frame):
    df = frame([("a", f"2023-01-0{i}", float(i)) for i in range(1, 7)], "k string, Date date, v double")
    r = S.rolling(["k"], "Date", "v", 7, 1)
    got = df.withColumns(r).orderBy("Date").collect()
    assert got[0].rolling_std_7 is None and got[0].rolling_mean_7 == 1 and got[5].rolling_mean_7 == 3.5
    strict = df.withColumns(S.rolling(["k"], "Date", "v", 7)).collect()
    assert all(x.rolling_mean_7 is None for x in strict)


def test_changes_pad_missing_values(frame):
    df = frame([("a", "2023-01-01", 10.0), ("a", "2023-01-02", None), ("a", "2023-01-03", 15.0)], "k string, Date date, v double")
    assert values(S.changes(df, ["k"], "Date", "v"), "a", "pct_change") == [None, 0.0, 0.5]
    assert values(S.changes(df, ["k"], "Date", "v"), "a", "diff") == [None, None, None]


def test_split_and_folds(frame):
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(11)]
    df = frame([("a", str(d), 1.0) for d in days], "k string, Date date, v double")
    assert values(S.positional_split(df, ["k"], "Date", 3), "a", "part") == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2, 2]
    folds = S.cv_folds(df, ["k"], "Date").groupBy("fold", "role").count().collect()
    assert {(r.fold, r.role): r["count"] for r in folds} == {
        (0, "train"): 5, (0, "test"): 2, (1, "train"): 7, (1, "test"): 2, (2, "train"): 9, (2, "test"): 2}


def test_short_series_rules(frame):
    def one(n):
        return frame([("a", str(dt.date(2023, 1, 1) + dt.timedelta(days=i)), float(i)) for i in range(n)], "k string, Date date, v double")

    assert S.seasonality(one(29), ["k"], "Date", "v").first().seasonal is False
    assert S.growth_between_ends(one(30), ["k"], "Date", "v").count() == 0
    assert S.growth_between_ends(one(31), ["k"], "Date", "v").first().rows == 31
    assert S.linear_trend(one(1), ["k"], "Date", "v").count() == 0
    assert S.linear_trend(one(2), ["k"], "Date", "v").first().slope == 1.0


def test_resample_labels_and_empty_buckets(frame):
    df = frame([("2023-01-02", 1.0), ("2023-01-17", 2.0)], "Date date, Quantity double")
    week = [(str(r.Date), r.Quantity) for r in S.resample(df, "W").orderBy("Date").collect()]
    assert week == [("2023-01-08", 1.0), ("2023-01-15", 0.0), ("2023-01-22", 2.0)]
    assert [(str(r.Date), r.Quantity) for r in S.resample(df, "M").collect()] == [("2023-01-31", 3.0)]


def test_decomposition_recovers_season(frame):
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(56)]
    season = [3, 1, -1, -3, -2, 0, 2]
    df = frame([("a", str(d), 0.5 * i + season[i % 7]) for i, d in enumerate(days)], "k string, Date date, v double")
    got = S.decompose(df, ["k"], "Date", "v", 7).orderBy("Date").collect()
    assert got[0].trend is None and got[3].trend is not None
    assert all(abs(r.seasonal - season[i % 7]) < 1e-9 for i, r in enumerate(got))
    assert all(abs(r.resid) < 1e-9 for r in got if r.resid is not None)


def test_many_series_equal_each_series_alone(frame):
    df = series(frame)
    both = S.fill_gaps(df, ["k"], "Date", ["v"], "interpolate")
    for k in "ab":
        alone = S.fill_gaps(df.where(F.col("k") == k), ["k"], "Date", ["v"], "interpolate")
        assert values(both, k) == values(alone, k)


def test_features_tolerate_missing_columns_and_nulls(frame):
    fin = frame([("2023-01-01", "w1", 5.0), ("2023-01-01", "w2", 5.0), ("2023-01-01", None, 9.0), ("2023-01-02", "w1", 1.0)], "Date date, Warehouse string, Quantity double")
    fout = frame([("2023-01-03", 4.0)], "Date date, Quantity double")
    got = {str(r.Date): r for r in A.warehouse_features(fin, fout).collect()}
    assert set(got) == {"2023-01-01", "2023-01-02"}
    day = got["2023-01-01"]
    assert (day.Total_Daily_Inflows, day.Total_Daily_Outflows, day.Active_Warehouses, day.Warehouse_Diversity) == (10.0, 0.0, 2, 0.5)
    perf = A.flow_performance(fin.withColumn("flow", F.lit("inflows")), "Warehouse")
    assert "in_value" not in perf.columns and perf.count() == 2


def test_moments_of_small_samples(frame):
    df = frame([("one", 4.0), ("two", 1.0), ("two", 3.0), ("flat", 2.0), ("flat", 2.0), ("flat", 2.0), ("flat", 2.0)]
               + [("x", v) for v in (1.0, 2.0, 3.0, 4.0, 10.0)], "k string, v double")
    got = {r.k: r for r in A.distribution(df, "v", ["k"]).collect()}
    assert got["one"].std is None and got["one"].skewness is None and got["two"].kurtosis is None and got["flat"].skewness is None
    # Bias-corrected values of 1, 2, 3, 4, 10.
    assert abs(got["x"].skewness - 1.6970562748477143) < 1e-9 and abs(got["x"].kurtosis - 3.152) < 1e-9


def test_label_alignment(frame):
    df = frame([("t", "a"), ("t", "a"), ("t", "b"), ("u", "a"), ("u", "c"), ("u", None)], "s string, l string")
    shares = J.two_sample_shares(df, "l", "s", "t", "u")
    assert {(r.l, round(r.p, 4), round(r.q, 4)) for r in shares.collect()} == {("a", 0.6667, 0.5), ("b", 0.3333, 0.0), ("c", 0.0, 0.5)}
    assert {(r.l, r.change) for r in J.label_changes(shares, "l").collect()} == {("c", "new"), ("b", "gone")}


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_calendar_equals_a_join_with_its_spine(frame):
    rows = [*GAPPY, ("a", "2023-01-02", 11.0), (None, "2023-03-01", 1.0), ("c", None, 4.0), ("d", "2023-01-31", 2.0)]
    df = series(frame, rows)
    got = S.on_calendar(df, ["k"], "Date").where("k is not null")
    want = S.spine(df, ["k"], "Date").join(df, ["k", "Date"], "left").where("k is not null")
    assert rows_of(got, "k", "Date", "v") == rows_of(want, "k", "Date", "v")
    # A missing key is a series like any other, and a key without a day has no calendar.
    assert S.on_calendar(df, ["k"], "Date").where("k is null and v = 1").count() == 1
    assert got.where("k = 'c'").count() == 0
    assert S.on_calendar(df.where("k = 'b'").drop("k"), [], "Date").count() == 3
    assert S.on_calendar(df.limit(0), ["k"], "Date").count() == 0


def test_methods_on_one_calendar_equal_each_by_itself(frame):
    df = series(frame).withColumn("method", F.lit(1)).drop("method").withColumn("w", F.col("v") * 2)
    methods = ("ffill", "bfill", "zero", "interpolate")
    got = S.fill_methods(df, ["k"], "Date", ["v", "w"], methods)
    for m in methods:
        want = S.fill_gaps(df, ["k"], "Date", ["v", "w"], m).select("k", "Date", "v", "w")
        assert rows_of(got.where(F.col("method") == m).select("k", "Date", "v", "w"), "k", "Date") == rows_of(want, "k", "Date")


def test_grains_from_one_table_of_days_equal_each_by_itself(frame):
    rows = [("a", f"2023-{m:02d}-{d:02d}", float(m * d) if d % 3 else None, float(d)) for m in (1, 2, 4) for d in (1, 1, 6, 17, 28)]
    df = frame(rows, "k string, Date date, s double, m double")
    how = {"s": "sum", "m": "mean"}
    got = S.resample_all(df, "DWM", columns=how, keys=["k"])
    for g in "DWM":
        want = S.resample(df, g, columns=how, keys=["k"]).select("Date", "s", "m")
        assert rows_of(got.where(F.col("grain") == g).select("Date", "s", "m"), "Date") == rows_of(want, "Date")


def test_profile_from_a_cube_equals_the_rows(frame):
    flows = frame(
        [("inflows", c, b, "w", "g", q, v) for c, b, q, v in (("x", "p", 1.0, 5.0), ("x", "p", None, 7.0), ("y", None, 4.0, None), (None, "p", 2.0, 9.0))]
        + [("outflows", "x", "r", "w", None, 3.0, 2.0)],
        "flow string, Category string, Brand string, Warehouse string, Grade string, Quantity double, Total_GIK double")
    cube = profile.label_cube(flows)
    for dim in ("Category", "Warehouse"):
        assert rows_of(A.flow_performance(cube, dim, shipments="shipments"), dim) == rows_of(A.flow_performance(flows, dim), dim)
    for label in profile.LABELS:
        assert rows_of(A.label_counts(cube, label, ["flow"], rows="rows"), "flow", label) == rows_of(A.label_counts(flows, label, ["flow"]), "flow", label)
    assert rows_of(A.value_by(flows, "Category"), "Category") == [("x", 14 / 3, 14.0, 3, 5.0)]


def test_stock_cover_by_hand(frame):
    days = [("s", "m", f"2023-01-{d:02d}", 100.0) for d in range(1, 11)]
    forecasts = frame([*days, ("s", "m", None, 5.0), ("none", "m", "2023-01-01", None)], "k string, model string, ds date, yhat double")
    scenarios = frame([("plenty", 1.0, 1.0, 2, 9.0, None), ("late", 1.0, 2.0, 3, 9.0, 4.0), ("timely", 3.0, 2.5, 2, 9.0, 6.0), ("beyond", 2.0, 1.0, 9, 9.0, 8.0)], P.SCENARIO)
    out = P.stock_cover(forecasts, scenarios, ["k"])
    day = lambda n: dt.date(2023, 1, n)
    got = {r["scenario"]: r.asDict() for r in out.collect()}
    assert set(got) == {"plenty", "late", "timely", "beyond"}
    # One unit a day: 100 start where no level is given.
    assert got["plenty"]["start_level"] == 100 and got["plenty"]["reorder_date"] is None and got["plenty"]["cover_days"] is None
    late = got["late"]
    assert (late["reorder_date"], late["stock_out_date"], late["arrival_date"], late["late"]) == (day(3), day(4), day(6), True)
    assert (late["lead_demand"], late["level_before_arrival"], late["short_of_safety"]) == (3, -2, 4)
    timely = got["timely"]
    assert (timely["reorder_date"], timely["safety_date"], timely["arrival_date"], timely["late"]) == (day(3), day(4), day(5), False)
    assert (timely["short_of_safety"], timely["cover_days"]) == (1.5, 5)
    # What an arrival beyond the horizon would need is not known.
    assert got["beyond"]["arrival_date"] == day(15) and got["beyond"]["lead_demand"] is None and got["beyond"]["late"]
    assert [r["scenario"] for r in P.compare_cover(out, ["k"]).orderBy("rank").collect()] == ["plenty", "timely", "beyond", "late"]
    assert P.stock_cover(forecasts.limit(0), scenarios, ["k"]).count() == 0
