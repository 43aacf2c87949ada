"""Codebooks on metric trees against a plain fit in whole numbers."""

import collections
import hashlib
import math

import numpy as np
import pytest

pytest.importorskip("stocktide.llm")

from pyspark.sql import functions as F  # noqa: E402

from stocktide.llm import metric_trees as M  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain(rows, entries, rounds, scale, parts):
    """Counter of (id, code, error, label error) and the digest; rows are (id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return collections.Counter(), None
    columns = -(-max(len(r[1]) for r in kept) // parts) * parts
    x = np.array([[math.floor(scale * v) for v in r[1]] + [0] * (columns - len(r[1])) for r in kept], dtype=np.int64).reshape(len(kept), columns)
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    codes, error, digest = [], np.zeros(len(kept), dtype=np.int64), []
    for part in np.split(x, parts, axis=1):
        book = part[order].copy()
        for last in range(rounds + 1):
            away = ((part[:, None, :] - book[None]) ** 2).sum(axis=2)
            best = away.argmin(axis=1)
            if last < rounds:
                for e in set(best.tolist()):
                    book[e] = part[best == e].sum(axis=0) // (best == e).sum()
        codes.append(best)
        error += away.min(axis=1)
        digest += book.ravel().tolist()
    by_label = collections.Counter()
    for r, e in zip(kept, error.tolist()):
        by_label[r[2]] += e
    out = collections.Counter((r[0], "".join(f"{c[i]:02x}" for c in codes), int(error[i]), by_label[r[2]]) for i, r in enumerate(kept))
    return out, hashlib.sha256(",".join(map(str, digest)).encode()).hexdigest()


def tried(spark, rows, entries=256, rounds=4, scale=1024, parts=4, block=M.BLOCK):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumns({"id": F.lit("clash"), "vector": F.lit(1), "error": F.lit(None)})
    found, books = M.codes(table, entries, rounds, scale, parts, block=block)
    got = found.collect()
    by_label = collections.Counter()
    for r in got:
        by_label[r.label] += r.error
    return collections.Counter((r.vec_id, r.code, r.error, by_label[r.label]) for r in got), M.books_digest(books) if got else None


def test_the_given_table_gets_the_plain_fit(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, digest = plain(rows, 256, 4, 1024, 4)
    got = M.op12_vector_codes(spark, SF).collect()
    assert collections.Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


@pytest.mark.parametrize("columns, block", [(8, 64), (7, 5), (3, 4096)])
def test_ties_copies_and_odd_vectors(spark, columns, block):
    rng = np.random.default_rng(columns)
    points = rng.integers(-3, 4, (400, columns)) / 4  # many equal parts and ties
    rows = [(int(i % 90) if i % 11 else None, p.tolist(), None if i % 5 == 0 else str(i % 3)) for i, p in enumerate(points)]
    rows += [(1000 + i, [0.25] * columns, "hot") for i in range(300)]
    rows += [(-5, None, "a"), (-4, [], "a"), (-3, [float("nan")] + [0.0] * (columns - 1), "a"), (-2, [float("inf")], None), (-1, [None, 1.0], "b"), (-6, [0.5], "b")]
    for entries in (9, 64):
        assert tried(spark, rows, entries, 3, 16, 4, block) == plain(rows, entries, 3, 16, 4)


def test_few_rows_and_none(spark):
    few = [(3, [0.1, 0.2, 0.3, 0.4], "x"), (1, [0.5, 0.2, 0.1, 0.4], None)]
    assert tried(spark, few) == plain(few, 256, 4, 1024, 4)
    assert tried(spark, []) == (collections.Counter(), None)
    assert tried(spark, [(1, None, "x"), (2, [float("nan")], "x")]) == (collections.Counter(), None)


@pytest.mark.parametrize("seed", range(6))
def test_trees_find_the_nearest_entry_and_own_balls_whole(seed):
    rng = np.random.default_rng(seed)
    middles = rng.integers(-2000, 2000, (9, 5))
    points = (middles[rng.integers(0, 9, 3000)] + rng.integers(-4, 5, (3000, 5))).astype(np.int32)
    points[:700] = points[0]
    if seed == 5:
        points = points.astype(np.int64) * 10_000  # beyond what doubles hold exactly
    entries = np.concatenate([middles * (10_000 if seed == 5 else 1) + 1, points[:20], points[:3]]).astype(np.int64)
    whole: list[int] = []
    tree = M.Tree(points)
    found, count, total = tree.nearest(entries, whole)
    away = ((points[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    want = np.array([int(np.argmin(a)) for a in away])
    assert (found == want).all()
    assert (count == np.bincount(want, minlength=len(entries))).all()
    assert all((total[e] == points[want == e].astype(np.int64).sum(axis=0)).all() for e in range(len(entries)))
    assert sum(whole) > 2000  # most points are never looked at
    again = M.Tree.of(points, tree.arrays())
    assert (again.nearest(entries)[0] == want).all()
    for (a, b), centre, radius, sums in zip(tree.range, tree.centre, tree.radius, tree.total):
        held = points[tree.order[a:b]].astype(np.float64)
        assert np.sqrt(((held - centre) ** 2).sum(axis=1)).max() <= radius + 1e-6 * (1 + radius)
        assert (held.astype(np.int64).sum(axis=0) == sums).all()
