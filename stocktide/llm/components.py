"""Connected components by alternating large and small stars, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.session import materialize


def components(links: DataFrame) -> DataFrame:
    """`node`, `root` (smallest node reachable) for every node of the links `a`, `b`.

    A round joins each link with the smallest neighbour of one of its ends, so no neighbour list is
    ever gathered; rounds end when the table no longer changes. The joins are outer ones, though every
    link finds its neighbour: so only the neighbours may be sent whole, never the links, whose files
    are far smaller than their rows.
    """
    pairs = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct()
    state, before = materialize(pairs, "links"), None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = state.select(F.col("lo").alias("c"), F.least("lo", "hi").alias("m")).union(state.select(F.col("hi"), F.col("lo")))
        least = both.groupBy(F.col("c").alias("lo")).agg(F.min("m").alias("m"))
        large = state.join(least, "lo", "left").select("hi", F.col("m").alias("lo")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi", "left").where("not lo <=> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        state = materialize(small.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "small")
    roots = state.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(state.select(F.col("lo"), F.col("lo")).distinct())
