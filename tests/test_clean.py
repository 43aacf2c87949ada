import math

import pytest
from pyspark.sql import functions as F

from stocktide.functions import scalars as X
from stocktide.operators import clean as C
from stocktide.operators import paging
from stocktide.operators import quality as Q
from stocktide.operators import ranks
from stocktide.sources import files

DIRTY = [
    ("13/01/23", "100", 1), ("01/02/23", "200", 2), ("nonsense", "300", 3), ("02/02/23", None, 4),
    ("03/02/23", "many", 5), ("13/01/23", "-5", 6),
]


@pytest.fixture
def dirty(frame):
    return frame(DIRTY, "Date string, Inventory_Level string, seq int")


def test_dates_follow_the_stated_format_only(dirty):
    got = [r[0] for r in C.typed(dirty, "inventory", "dd/MM/yy").orderBy("seq").select(F.col("Date").cast("string")).collect()]
    assert got == ["2023-01-13", "2023-02-01", None, "2023-02-02", "2023-02-03", "2023-01-13"]


def test_row_rules_count_each_violation(dirty):
    df = C.typed(dirty, "inventory", "dd/MM/yy")
    got = {r["rule"]: r["n"] for r in Q.count_rules(df, Q.row_rules(df)).collect()}
    assert got == {"invalid_date": 1, "level_not_numeric": 2, "level_negative": 1}


def test_header_names_lose_mark_and_spaces(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿Date, Inventory_Level \n13/01/23,5\n", encoding="utf-8")
    df = files.read_csv(spark, str(p), "inventory", "dd/MM/yy")
    assert [tuple(r) for r in df.select(F.col("Date").cast("string"), "Inventory_Level").collect()] == [("2023-01-13", 5.0)]


def test_json_array_with_iso_dates(spark, tmp_path):
    p = tmp_path / "tune_inventory.json"
    p.write_text('[{"Date": "2023-01-01", "Inventory_Level": 1053349}, {"Date": "2023-01-02", "Inventory_Level": 1062989}]')
    got = files.load_json_array(spark, str(p), "inventory").orderBy("Date").collect()
    assert [(str(r[0]), r[1]) for r in got] == [("2023-01-01", 1053349.0), ("2023-01-02", 1062989.0)]


def test_missing_dataset_is_none(spark, tmp_path):
    assert files.load_dataset(spark, str(tmp_path), "inflows") is None
    assert files.catalog(spark, str(tmp_path)).count() == 0


def test_safe_arithmetic_defaults(frame):
    df = frame([(0.0, 5.0), (None, 5.0), (-4.0, 2.0)], "a double, b double")
    got = df.select(X.safe_divide(F.col("b"), F.col("a"), -1).alias("q"), X.percent_change(F.col("a"), F.col("b")).alias("c"),
                    X.compound_growth(F.col("a"), F.col("b"), F.lit(2)).alias("g")).collect()
    assert [r.q for r in got] == [-1.0, -1.0, -0.5]
    assert [r.c for r in got] == [0.0, 0.0, 150.0]
    assert [r.g for r in got] == [0.0, 0.0, 0.0]


def test_quantiles_match_brute_force_with_hot_value_and_keys(spark, frame):
    import numpy as np

    rng = np.random.default_rng(7)
    rows = [("a", float(v)) for v in np.where(rng.random(400) < 0.4, 12.5, rng.normal(0, 50, 400))]
    rows += [("b", float(v)) for v in rng.exponential(1e6, 57)] + [("c", 3.0), ("b", None)]
    df = frame(rows, "k string, v double")
    got = {r.k: r for r in ranks.quantiles(df, "v", {"q01": 0.01, "q5": 0.5, "q97": 0.97}, ["k"]).collect()}
    for k in "abc":
        x = [v for kk, v in rows if kk == k and v is not None]
        assert np.allclose([got[k].q01, got[k].q5, got[k].q97], np.percentile(x, [1, 50, 97]), rtol=1e-12)


def test_median_deviation_and_constant_series(frame):
    df = frame([(5.0,)] * 20, "v double")
    r = ranks.median_deviation(df, "v").first()
    assert (r.median, r.mad) == (5.0, 0.0)
    assert {x.normalized for x in C.normalize(df, "v", "minmax").collect()} == {0.5}
    assert {x.normalized for x in C.normalize(df, "v", "zscore").collect()} == {0.0}
    assert {x.normalized for x in C.normalize(df, "v", "robust").collect()} == {0.0}
    assert {x.s for x in C.robust_scale(df, "v", "s").collect()} == {0.0}


def test_winsorizing_keeps_missing_and_clips(frame):
    df = frame([(float(i),) for i in range(1, 101)] + [(None,), (10_000.0,)], "v double")
    vals = [r.v for r in C.winsorize(df, "v").collect()]
    assert vals.count(None) == 1 and max(v for v in vals if v is not None) == pytest.approx(100.0)
    by_rank = sorted(r.v for r in C.winsorize_by_rank(df.na.drop(), "v", limits=(0.02, 0.02)).collect())
    # 101 values: two cut at each end.
    assert by_rank[:3] == [3.0, 3.0, 3.0] and by_rank[-3:] == [99.0, 99.0, 99.0]


def test_scaling_round_trip(frame):
    df = frame([("a", float(i)) for i in range(9)] + [("b", 4.0)] * 3, "k string, y double")
    p = C.scale_parameters(df, "y", ["k"])
    back = C.standardize(C.standardize(df, p, ["y"], ["k"]), p, ["y"], ["k"], inverse=True)
    assert sorted((r.k, round(r.y, 9)) for r in back.collect()) == sorted((r.k, r.y) for r in df.collect())


def test_label_codes_follow_sorted_order(frame):
    df = frame([("pear",), ("apple",), (None,), ("fig",), ("apple",)], "l string")
    got = sorted((r.l or "", r.code) for r in C.label_codes(df, "l", "code").collect())
    assert got == [("", -1), ("apple", 0), ("apple", 0), ("fig", 1), ("pear", 2)]


def test_missing_cells_and_dropping(frame):
    df = frame([(1.0, None), (None, "x"), (3.0, "y"), (None, None)], "Quantity double, Brand string")
    filled = C.fill_missing(df, medians=["Quantity"], unknown=["Brand"]).collect()
    assert sorted((r.Quantity, r.Brand) for r in filled) == [(1.0, "Unknown"), (2.0, "Unknown"), (2.0, "x"), (3.0, "y")]
    assert C.drop_incomplete(df, ["Quantity", "Brand"], "any").count() == 1
    assert C.drop_incomplete(df, ["Quantity", "Brand"], "all").count() == 3


def test_clean_plus_rejects_is_everything(frame):
    rows = [("2023-01-01", "5", "9"), ("bad", "5", "9"), ("2023-01-02", None, "1"), ("2023-01-03", "7", None)]
    df = frame(rows, "Date string, Quantity string, Total_GIK string")
    kept = C.clean_table(df, "inflows")
    typed = C.typed(df, "inflows")
    rejected = typed.where(F.col("Date").isNull() | F.col("Quantity").isNull())
    assert kept.count() + rejected.count() == df.count() == 4


def test_pages_do_not_overlap_and_zero_limit_means_all(frame):
    df = frame([(f"2023-01-{d:02d}", i) for d in range(1, 6) for i in (1, 2)], "Date date, id int")
    order = ["Date", "id"]
    full = [(r.Date, r.id) for r in paging.page(df, order).collect()]
    assert len(full) == 10
    parts = [[(r.Date, r.id) for r in paging.page(df, order, 4, o).collect()] for o in (0, 4, 8)]
    assert parts[0] + parts[1] + parts[2] == full
    rest = paging.page(df, order, 0, 7).collect()
    assert [(r.Date, r.id) for r in rest] == full[7:] and rest[0].total_records == 10
    assert paging.page(df, order, None, 10).count() == 0


def test_suggestions_and_consistency(frame):
    df = frame([("2023-01-01", None, 2e6)] * 3 + [("2024-01-01", -1.0, 5.0)], "Date date, Quantity double, Total_GIK double")
    issues = Q.consistency(df, "2023-06-30")
    assert {r.issue: r.n for r in issues.collect()} == {"Quantity_negative_values": 1, "Total_GIK_extreme_values": 3, "future_dates": 1}
    acts = {(r.action, r.subject) for r in Q.suggestions(Q.assessment(df), issues).collect()}
    assert ("remove_column", "Quantity") in acts and ("remove_duplicates", "rows") in acts and ("fix_consistency", "future_dates") in acts


def test_bucket_is_monotone(frame):
    vals = [-1e9, -3.2, -1e-7, 0.0, 1e-9, 0.4, 0.4000001, 7.0, 1e12]
    got = [r.b for r in frame([(v,) for v in vals], "v double").select("v", ranks.bucket_of("v").alias("b")).orderBy("v").collect()]
    assert got == sorted(got) and not any(math.isnan(b) for b in got)
