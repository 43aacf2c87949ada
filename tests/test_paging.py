"""Deep pages: located by counts of ranges, never by dragging or writing what is skipped."""

import random

import pytest
from pyspark.sql import functions as F

from stocktide.operators import paging


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = [(f"2020-{1 + rng.randrange(3):02d}-{1 + rng.randrange(28):02d}" if rng.random() > 0.05 else None, k, rng.choice([None, "a", "b"])) for k in range(3000)]
    rows += [("2020-02-02", k, "hot") for k in range(3000, 5000)]
    df = spark.createDataFrame(rows, "d string, id long, s string").select(F.to_date("d").alias("Date"), "id", "s")
    want = sorted(((r.Date is not None, r.Date, r.id) if r.Date else (False, None, r.id) for r in df.collect()), key=lambda x: (x[0], str(x[1]), x[2]))
    return df, [(str(d) if d else None, i) for _, d, i in want]


@pytest.mark.parametrize("offset, limit", [(0, 7), (1, 5), (137, 40), (2500, 600), (4993, 50), (4999, 1), (5000, 5), (9000, 5), (4200, None)])
def test_pages_of_a_table_with_missing_and_hot_dates(table, monkeypatch, offset, limit):
    monkeypatch.setattr(paging, "LARGEST", 60)
    df, want = table
    got = paging.page(df, ["Date", "id"], limit, offset).collect()
    assert [(r.Date, r.id) for r in got] == want[offset:offset + limit if limit else None]
    assert {r.total_records for r in got} <= {5000}


def test_every_position_is_located(table, monkeypatch):
    monkeypatch.setattr(paging, "LARGEST", 50)
    df, want = table
    for position in (0, 3, 160, 2000, 4998):
        (day, i), before = paging.locate(df, ["Date", "id"], position, 5000)
        assert (str(day) if day else None, i) == want[position] and before == position


def test_rows_that_share_the_whole_key(spark, monkeypatch):
    monkeypatch.setattr(paging, "LARGEST", 10)
    df = spark.createDataFrame([("2020-01-01", 1)] * 30 + [("2020-01-02", 1)] * 40 + [("2020-01-03", 2)], "d string, id long").select(F.to_date("d").alias("Date"), "id")
    got = paging.page(df, ["Date", "id"], 35, 20).collect()
    assert [r.Date for r in got] == ["2020-01-01"] * 10 + ["2020-01-02"] * 25


def test_a_deep_page_writes_nothing_and_reads_on_from_its_key(spark, monkeypatch):
    monkeypatch.setattr(paging, "LARGEST", 500)
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select(F.col("l_shipdate").alias("Date"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"))
    plan = paging.page(df, ["Date", "id"], 20, 40_000)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=20" in plan and "GreaterThanOrEqual(l_shipdate" in plan.replace("PushedFilters", "") and "Window" not in plan
