"""Isolation trees (Liu, Ting and Zhou 2008).

Every tree sees a uniform sample of at most 256 rows, chosen by hashing the row
id with the tree number, so a rerun task picks the same rows. Trees grow one per
task; the forest (trees x nodes, bounded by its parameters) then scores all rows
where they are.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocktide.operators.ranks import counted, quantiles, quantiles_of
from stocktide.session import materialize

# Task-side helpers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES, SAMPLE = 100, 256
_RANGE = 2.0**32


def expected_depth(n):
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    out = 2.0 * (np.log(safe - 1.0) + 0.5772156649015329) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature or -1, threshold, left, right, path length at a leaf)."""
    nodes: list = []

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        part = x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or len(open_features) == 0:
            nodes[at] = (-1, 0.0, -1, -1, depth + float(expected_depth(len(rows))))
            return at
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(lo[f], hi[f]))
        left = part[:, f] < cut
        if not left.any():
            left = part[:, f] <= lo[f]
        nodes[at] = (f, cut, build(rows[left], depth + 1), build(rows[~left], depth + 1), 0.0)
        return at

    build(np.arange(len(x)), 0)
    return nodes


def path_lengths(nodes, x: np.ndarray) -> np.ndarray:
    feature, cut, left, right, leaf = (np.array(c) for c in zip(*nodes))
    at = np.zeros(len(x), dtype=int)
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return leaf[at]
        rows = np.flatnonzero(inner)
        here = at[rows]
        goes_left = x[rows, feature[here]] < cut[here]
        at[rows] = np.where(goes_left, left[here], right[here])


def forest(df: DataFrame, row_id: str, features: Sequence[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42):
    """Grow the trees; returns (list of node lists, effective sample size)."""
    n = df.count()
    size = min(sample, n)
    clean = df.select(F.col(row_id).cast("string").alias("_id"), *[F.col(c).cast("double").alias(c) for c in features])
    # Thin first by row so that only a pool of candidates meets every tree. The
    # margins make it all but certain that each tree finds `size` rows.
    share = min(1.0, (size + 8 * math.sqrt(size) + 8) / max(n, 1))
    keep = min(1.0, 4 * trees * share)
    unit = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(int(_RANGE))) / _RANGE
    pool = clean.where(unit("_id", F.lit(seed)) < keep)  # one rule at every size
    drawn = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    drawn = drawn.withColumn("_h", unit("_id", "tree", F.lit(seed + 1))).where(F.col("_h") < share / keep)
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    names = list(features)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # Bounded by the draw: about `size` rows whatever the table holds.
        part = pdf.sort_values(["_h", "_id"]).head(size)
        rng = np.random.default_rng(seed * 1009 + int(key[0]))
        nodes = grow(part[names].to_numpy(dtype=float), rng, limit)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "leaf"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", int(key[0]))
        return out

    schema = "tree int, node int, feature int, cut double, left int, right int, leaf double"
    rows = drawn.groupBy("tree").applyInPandas(one, schema).toPandas().sort_values(["tree", "node"])
    model = [list(map(tuple, g[["feature", "cut", "left", "right", "leaf"]].to_numpy().tolist())) for _, g in rows.groupby("tree")]
    return [[(int(f), c, int(a), int(b), d) for f, c, a, b, d in t] for t in model], size


def score(df: DataFrame, model, size: int, features: Sequence[str]) -> DataFrame:
    """Adds `anomaly_score` in (0, 1); larger is more isolated."""
    names = list(features)
    shared = df.sparkSession.sparkContext.broadcast(model)
    norm = float(max(expected_depth(size), 1e-9))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            depth = np.mean([path_lengths(t, x) for t in shared.value], axis=0) if len(pdf) else np.array([])
            yield pdf.assign(anomaly_score=np.power(2.0, -depth / norm))

    schema = T.StructType([*df.schema.fields, T.StructField("anomaly_score", T.DoubleType())])
    return df.mapInPandas(run, schema)


def isolation_outliers(df: DataFrame, row_id: str, features: Sequence[str], contamination: float = 0.1, seed: int = 42, min_rows: int = 10, trees: int = TREES,
                       sample: int = SAMPLE) -> DataFrame:
    """Rows whose score exceeds the (1 - contamination) quantile of all scores.

    Each of `trees` trees grows from `sample` rows; every row is scored. Rows with a missing feature take
    no part; `min_rows` or fewer give no outliers.
    """
    rows = df.na.drop(subset=list(features))
    if rows.limit(min_rows + 1).count() <= min_rows:
        return rows.limit(0).withColumn("anomaly_score", F.lit(0.0))
    model, size = forest(rows, row_id, features, trees, sample, seed)
    # Scored once, read for the cut and for the rows beyond it.
    scored = materialize(score(rows, model, size, features), "scores")
    cut = quantiles(scored, "anomaly_score", {"q": 1 - contamination}).select("q").scalar()
    return scored.where(F.col("anomaly_score") > cut)


# ---------------------------------------------------------------- one measure, many groups

GROUPS = 64  # forests that are sent to the tasks at a time


def steps_of(trees_: Sequence[Sequence[tuple]]) -> tuple[np.ndarray, np.ndarray]:
    """The mean path length of a forest over one feature as a step function: cuts in order, and the length from each cut on.

    The first length holds below the first cut.
    """
    cuts, gains, base = [], [], 0.0
    for nodes in trees_:
        order: list[tuple[float, float]] = []  # (cut on the left of the leaf, its length)
        stack = [(0, -math.inf)]
        while stack:
            at, low = stack.pop()
            feature, cut, left, right, leaf = nodes[at]
            if feature < 0:
                order.append((low, leaf))
            else:
                stack += [(right, cut), (left, low)]
        base += order[0][1]
        for (_, before), (cut, after) in zip(order, order[1:]):
            cuts.append(cut)
            gains.append(after - before)
    at = np.argsort(cuts, kind="stable")
    return np.array(cuts, dtype=float)[at], (base + np.concatenate([[0.0], np.cumsum(np.array(gains, dtype=float)[at])])) / len(trees_)


def forests_by_key(rows: DataFrame, counts: DataFrame, keys: Sequence[str], row_id: str, value: str, trees: int = TREES, sample: int = SAMPLE, seed: int = 42,
                   min_rows: int = 10) -> DataFrame:
    """Keys, sample size and the step function of a forest for every key; all trees of all keys grow in one job."""
    keys = list(keys)
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("_n")).where(F.col("_n") > min_rows)
    size = F.least(F.lit(sample), F.col("_n")).cast("double")
    share = F.least(F.lit(1.0), (size + 8 * F.sqrt(size) + 8) / F.col("_n"))
    sizes = materialize(sizes.select(*keys, size.cast("int").alias("_size"), share.alias("_share"), F.least(F.lit(1.0), 4 * trees * share).alias("_keep")), "forest_sizes")
    unit = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(int(_RANGE))) / _RANGE
    clean = rows.where(F.col(value).isNotNull()).select(*keys, F.col(row_id).cast("string").alias("_id"), F.col(value).cast("double").alias("_v"))
    pool = clean.join(sizes, keys).where(unit("_id", F.lit(seed)) < F.col("_keep"))
    drawn = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    drawn = drawn.withColumn("_h", unit("_id", "tree", F.lit(seed + 1))).where(F.col("_h") < F.col("_share") / F.col("_keep"))
    names = list(keys)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        most = int(pdf["_size"].iloc[0])
        part = pdf.sort_values(["_h", "_id"]).head(most)
        rng = np.random.default_rng(seed * 1009 + int(key[-1]))
        nodes = grow(part[["_v"]].to_numpy(dtype=float), rng, max(1, math.ceil(math.log2(max(most, 2)))))
        out = pd.DataFrame([(*key, most, [list(map(float, n)) for n in nodes])], columns=[*names, "tree", "_size", "nodes"])
        return out

    head = "".join(f"`{k}` {dict(rows.dtypes)[k]}, " for k in keys)
    grown = drawn.groupBy(*keys, "tree").applyInPandas(one, head + "tree int, _size int, nodes array<array<double>>")

    def together(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """At most `trees` rows of bounded size."""
        pdf = pdf.sort_values("tree")
        cuts, lengths = steps_of([[(int(f), c, int(a), int(b), d) for f, c, a, b, d in nodes] for nodes in pdf["nodes"]])
        return pd.DataFrame([(*key, int(pdf["_size"].iloc[0]), cuts.tolist(), lengths.tolist())], columns=[*names, "size", "cuts", "lengths"])

    return grown.groupBy(*keys).applyInPandas(together, head + "size int, cuts array<double>, lengths array<double>")


def score_counts(counts: DataFrame, forests: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The distinct values with `anomaly_score`; forests go to the tasks in blocks of keys, the values of a block are read once."""
    keys, spark = list(keys), counts.sparkSession
    held = materialize(forests.withColumn("_block", F.floor((F.row_number().over(Window.orderBy(*keys)) - 1) / GROUPS)), "forests")  # a row for each key
    blocks = (held.agg(F.max("_block").alias("b")).first()["b"] or 0) + 1
    schema = T.StructType([*counts.schema.fields, T.StructField("anomaly_score", T.DoubleType())])
    result = None
    for block in range(blocks):
        part = held.where(F.col("_block") == block).drop("_block")
        shared = spark.sparkContext.broadcast({tuple(r[k] for k in keys): (float(max(expected_depth(r["size"]), 1e-9)), np.array(r["cuts"]), np.array(r["lengths"])) for r in part.collect()})

        def run(batches, shared=shared):
            for pdf in batches:
                done = np.full(len(pdf), np.nan)
                for key, at in pdf.groupby(keys, sort=False).indices.items():
                    known = shared.value.get(key if isinstance(key, tuple) else (key,))
                    if known:
                        norm, cuts, lengths = known
                        depth = lengths[np.searchsorted(cuts, pdf[value].to_numpy(dtype=float)[at], side="right")]
                        done[at] = np.round(np.power(2.0, -depth / norm), 12)
                yield pdf.assign(anomaly_score=done)

        scored = counts.join(part.select(*keys), keys, "left_semi").mapInPandas(run, schema)
        result = scored if result is None else result.unionByName(scored)
    return result


def isolation_by_key(rows: DataFrame, keys: Sequence[str], row_id: str, value: str, contamination: float = 0.1, seed: int = 42, min_rows: int = 10, trees: int = TREES,
                     sample: int = SAMPLE) -> DataFrame:
    """Rows of each key whose score exceeds the (1 - contamination) quantile of the key's scores, as `isolation_outliers` for each by itself.

    One scan counts the values, one grows the trees of all keys; only distinct values are scored.
    """
    keys = list(keys)
    counts = counted(rows, value, keys)
    scored = materialize(score_counts(counts, forests_by_key(rows, counts, keys, row_id, value, trees, sample, seed, min_rows), keys, value), "scores")
    by_score = materialize(scored.groupBy(*keys, "anomaly_score").agg(F.sum("n").alias("n")), "score_counts")
    cut = quantiles_of(by_score, "anomaly_score", {"_cut": 1 - contamination}, keys)
    beyond = scored.join(cut, keys).where(F.col("anomaly_score") > F.col("_cut")).select(*keys, value, "anomaly_score")
    return rows.join(materialize(beyond, "isolated"), [*keys, value])
