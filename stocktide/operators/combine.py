"""Joins, set operations and top-k forms used across the library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import known, over, ratio, with_totals
from .ranks import value_counts


def full_outer(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer equi-join with missing numbers as zero."""
    return a.join(b, list(on), "full").na.fill(0)


def two_sample_shares(df: DataFrame, label: str, sample: str, first: str, second: str) -> DataFrame:
    """Share of each label in two samples over the union of labels.

    One aggregation counts both sides; labels absent on one side count 0 there.
    """
    n1, n2 = F.col(sample) == first, F.col(sample) == second
    counts = value_counts(df.where(n1 | n2), label, samples={"n1": n1, "n2": n2})
    out = with_totals(counts, [], t1=F.sum("n1"), t2=F.sum("n2"))
    return out.select(label, "n1", "n2", ratio("n1", "t1", 0.0).alias("p"), ratio("n2", "t2", 0.0).alias("q"))


def label_changes(shares: DataFrame, label: str) -> DataFrame:
    """Labels only in the second sample (new) or only in the first (gone)."""
    state = F.when(F.col("n1") == 0, "new").when(F.col("n2") == 0, "gone")
    return shares.select(label, state.alias("change")).where(F.col("change").isNotNull())


def top_k(df: DataFrame, measure: str, k: int, tie: str, keys: Sequence[str] = (), largest=True) -> DataFrame:
    order = [F.desc(measure) if largest else F.asc(measure), F.asc(tie)]
    if not keys:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_r", F.row_number().over(over(keys, *order))).where(F.col("_r") <= k).drop("_r")


def extreme_rows(df: DataFrame, measure: str, tie: str, keys: Sequence[str] = ()) -> DataFrame:
    """The row with the largest and the one with the smallest measure per key."""
    rest = [c for c in df.columns if c not in keys]
    low = F.struct(F.col(measure), F.col(tie))
    high = F.struct((-F.col(measure)), F.col(tie))
    both = known(df, [measure]).groupBy(*keys).agg(
        F.min_by(F.struct(*rest), high).alias("max"), F.min_by(F.struct(*rest), low).alias("min"))
    long = both.select(*keys, F.explode(F.array(
        F.struct(F.lit("max").alias("side"), F.col("max").alias("r")), F.struct(F.lit("min").alias("side"), F.col("min").alias("r")))).alias("e"))
    return long.select(*keys, "e.side", "e.r.*")
