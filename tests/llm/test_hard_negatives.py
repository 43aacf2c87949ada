"""Hard negatives by the inverted multi-index against all scores."""

import collections
import itertools
import math

import numpy as np
import pytest

pytest.importorskip("stocktide.llm")

from pyspark.sql import functions as F  # noqa: E402

from stocktide.llm import hard_negatives as H  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain(rows, is_anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    """Counter of the result's rows; rows are (id, vector, label)."""
    kept = [r for r in rows if r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    columns = max((len(r[1]) for r in kept), default=0)
    x = np.array([[math.floor(scale * v) for v in r[1]] + [0] * (columns - len(r[1])) for r in kept], dtype=object).reshape(len(kept), columns)
    place = [(r[0] is None, r[0] or 0) for r in kept]
    out = collections.Counter()
    for a, row in enumerate(kept):
        if not is_anchor(row[0]):
            continue
        score = [int(sum(p * q for p, q in zip(x[a], y))) for y in x]
        order = sorted((b for b in range(len(kept)) if b != a), key=lambda b: (-score[b], place[b]))
        for p in [b for b in order if kept[b][2] == row[2]][:positives]:
            fits = [b for b in order if kept[b][2] != row[2] and low * score[p] <= 100 * score[b] <= high * score[p]]
            for rank, n in enumerate(fits[:negatives], 1):
                out[row[0], kept[p][0], rank, kept[n][0], score[p], score[n]] += 1
    return out


def tried(spark, rows, is_anchor, **sizes):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumns({"uid": F.lit("clash"), "id": F.lit(0), "shelf": F.lit(None)})
    return collections.Counter(map(tuple, H.hard_negatives(table, is_anchor, **sizes).collect()))


def test_the_given_table_against_all_scores(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert collections.Counter(map(tuple, H.op13_hard_negatives(spark, SF).collect())) == plain(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("columns, first, growth, shelf", [(6, 5, 3, 8), (5, 40, 100, None)])
def test_ties_copies_and_odd_rows_in_many_rounds(spark, columns, first, growth, shelf):
    rng = np.random.default_rng(columns)
    middles = rng.normal(size=(5, columns)) * 4
    points = np.rint((middles[rng.integers(0, 5, 260)] + rng.normal(size=(260, columns)) * 0.2) * 8) / 8
    rows = [(int(i // 2), p.tolist(), str(rng.integers(0, 3))) for i, p in enumerate(points)]  # every id twice
    rows += [(900 + i, middles[0].round(2).tolist(), "hot") for i in range(60)]  # ties by the dozen
    rows += [(None, middles[1].tolist(), "0"), (None, middles[1].tolist(), "1"), (10, None, "0"), (20, [], "0"), (30, [float("nan")] * columns, "0"),
             (40, [float("-inf")] + [0.0] * (columns - 1), "1"), (50, [None] * columns, "1"), (60, middles[2].tolist(), None), (70, [1.0], "0"), (80, (-middles[0]).tolist(), "alone")]
    got = tried(spark, rows, F.col("vec_id") % 10 == 0, first=first, growth=growth, shelf=shelf, entries=6)
    assert got == plain(rows, lambda i: i is not None and i % 10 == 0)


def test_nothing_to_find(spark):
    assert tried(spark, [], F.lit(True)) == collections.Counter()
    assert tried(spark, [(1, None, "a"), (2, [1.0], None)], F.lit(True)) == collections.Counter()
    assert tried(spark, [(1, [1.0, 0.0], "a"), (2, [1.0, 0.5], "b")], F.lit(True)) == collections.Counter()  # no positives
    assert tried(spark, [(i, [], str(i % 2)) for i in range(6)], F.col("vec_id") < 1) == plain([(i, [], str(i % 2)) for i in range(6)], lambda i: i < 1)


def test_walks_see_cells_by_bound_and_bounds_hold():
    rng = np.random.default_rng(3)
    points = rng.integers(-300, 300, (2000, 10))
    books = [H.codebook(half, 8) for half in np.split(points, 2, axis=1)]
    (i, r1), (j, r2) = (H.nearest(half, book) for half, book in zip(np.split(points, 2, axis=1), books))
    Cell = collections.namedtuple("Cell", "i j n r1 r2")
    cells = [Cell(a, b, int(((i == a) & (j == b)).sum()), int(r1[(i == a) & (j == b)].max()), int(r2[(i == a) & (j == b)].max()))
             for a, b in itertools.product(range(8), range(8)) if ((i == a) & (j == b)).any()]
    index = H.Index(books, cells, 50)
    queries = points[:40]
    first, second = (index.bounds(h, half) for h, half in enumerate(np.split(queries, 2, axis=1)))
    assert (H.dots(queries, points) <= first[:, i] + second[:, j]).all()
    sums = {(c.i, c.j): first[0, c.i] + second[0, c.j] for c in cells}
    seen, shelves, rounds = H.END, set(), 0
    while seen > -H.END:
        until, found = index.walk(first[0], second[0], seen, 300, -H.END)
        new = [c for c, s in sums.items() if until < s <= seen]
        assert set(found) == {x for c in new for x in range(index.shelf[c], index.shelf[c] + index.shelves[c])}
        assert until == -H.END or sum(index.count[c] for c in new) >= 300
        seen, shelves, rounds = until, shelves | set(found), rounds + 1
    assert 3 < rounds and len(shelves) == len({x for c in sums for x in range(index.shelf[c], index.shelf[c] + index.shelves[c])})


def test_certified_windows_end_a_walk_early(spark):
    """Far groups of vectors are never met: the certified rows come from the group of the anchor."""
    rng = np.random.default_rng(8)
    middles = np.eye(8) * 10
    rows = [(i, (middles[i % 8] + rng.normal(size=8) * 0.05).tolist(), str(i // 8 % 3)) for i in range(800)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    kept, index, columns = H.indexed(table, F.col("vec_id") == 0, entries=16, shelf=16)
    anchors = kept.where("is_anchor").select("uid", "label", "vector", F.array(F.lit(-H.END)).alias("lows"), F.array(F.lit(H.END)).alias("highs"))
    best = H.first_in_windows(kept, index, columns, anchors, True, 5, first=32, growth=2).collect()
    assert {r.id % 8 for r in best} == {0} and len(best) == 5
    vector = np.frombuffer(bytes(anchors.first().vector), dtype="<i4").reshape(1, -1).astype(np.int64)
    bounds = [index.bounds(h, half)[0] for h, half in enumerate(np.split(vector, 2, axis=1))]
    fifth = min(r.score for r in best)
    reach = sum(int(index.count[i, j]) for i, j in itertools.product(*(range(len(b)) for b in index.books)) if bounds[0][i] + bounds[1][j] >= fifth)
    assert reach < 400  # rows that can reach the fifth score: the walk may stop before the others
