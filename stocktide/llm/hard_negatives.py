"""Hard negatives of labelled vectors by an inverted multi-index.

A codebook for either half of the vectors splits them into cells (a pair of entries). The codebooks are
fitted on a bounded sample; the index holds every row. What a half of an anchor can score with an entry's
members is at most its score with the entry plus its length times the entry's radius, so the sum of two
halves bounds a whole cell. A heap walks the cells of each anchor from the highest sum down (the
multi-sequence walk) until enough rows are met; the anchor goes to the shelves that hold these cells, its
scores there are exact, and the walk goes on in the next round, over many times the rows, until each of
its windows is certified: the wanted rows all score above what any cell not yet seen can hold, or the
window ends above that. Answers are exact; the bounds only say when to stop.

A shelf is a bounded number of rows: small cells share one, a large cell (copies of one vector) is dealt
over many. Rows of a shelf are held in a task, the anchors that visit it stream by. Rounds are written.

Cases: rows with a null label, a null vector or a component that is no finite number take no part; shorter
vectors are filled up with zeros; a missing id comes after all others among ties and is never an anchor;
rows that repeat an id are rows of their own (as anchors too); fewer positives or negatives than asked
for are all returned, an anchor without positives returns nothing; windows of negative positive scores are
empty; other columns are ignored; an empty table gives an empty result; integer components of 2^26 and
more are refused.
"""

from __future__ import annotations

import heapq
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stocktide.session import materialize

from .common import arrow_schema, read, slices
from .vectors import exact_in_doubles, finite, integers, width

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENTRIES = 32  # of a half's codebook: 1,024 cells
SAMPLE = 4096  # rows that the codebooks are fitted on
FIRST, GROWTH = 512, 16  # rows an anchor meets in the first round, and times as many in each next one
SHELF = 8192  # rows of a shelf at most, but for the last cell on it
END = 1 << 62
NO_ID = (1 << 63) - 1


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b."""
    if exact_in_doubles(a, b):
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def codebook(points: np.ndarray, entries: int, rounds: int = 8) -> np.ndarray:
    """Whole-numbered centres of a sample."""
    book = np.unique(points, axis=0) if points.shape[1] else points[:1]
    book = book[np.linspace(0, len(book) - 1, min(entries, len(book))).astype(int)].astype(np.int64)
    for _ in range(rounds if len(book) else 0):
        best = nearest(points, book)[0]
        for e in np.unique(best):
            book[e] = np.rint(points[best == e].mean(axis=0))
    return book


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    away = (points * points).sum(axis=1)[:, None] - 2 * dots(points, book) + (book * book).sum(axis=1)
    best = away.argmin(axis=1)
    return best, away[np.arange(len(points)), best]


class Index:
    """Codebooks, radii and the places of the cells: everything a task needs to know, of fixed size."""

    def __init__(self, books, cells, shelf: int):
        """`cells`: i, j, rows, and the largest squared distances of the halves from their entries."""
        self.plain = books, cells, shelf  # an executor builds its own from these
        self.books, k = books, [len(b) for b in books]
        self.count = np.zeros(k, dtype=np.int64)
        self.square = [np.zeros(n, dtype=np.int64) for n in k]  # of the radius
        for i, j, rows, r1, r2 in cells:
            self.count[i, j] = rows
            self.square[0][i] = max(self.square[0][i], r1)
            self.square[1][j] = max(self.square[1][j], r2)
        before = np.cumsum(self.count.ravel()).reshape(k) - self.count
        self.shelf, self.shelves = before // shelf, np.maximum(1, -(-self.count // shelf))

    def bounds(self, half: int, queries: np.ndarray) -> np.ndarray:
        """The most that a half of each query can score with a member of each entry; equal in every task."""
        length = np.sqrt((queries * queries).sum(axis=1).astype(np.float64))
        reach = np.ceil(length[:, None] * np.sqrt(self.square[half].astype(np.float64)) * (1 + 1e-9)) + 1
        return dots(queries, self.books[half]) + reach.astype(np.int64)

    def walk(self, first: np.ndarray, second: np.ndarray, seen: int, rows: int, least: int) -> tuple[int, list[int]]:
        """Cells of an anchor from the highest sum of half bounds down: those above `seen` are known, those below `least` useless.

        Gives the sum below which the walk stopped (all cells above it are met) and the shelves of the new cells.
        """
        a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        first, second = first[a].tolist(), second[b].tolist()
        heap, met, shelves, last = [(-first[0] - second[0], 0, 0)], 0, set(), None
        while heap:
            sum_, x, y = heapq.heappop(heap)
            if -sum_ < least or (met >= rows and -sum_ != last):
                return -sum_, sorted(shelves)
            if y + 1 < len(second):
                heapq.heappush(heap, (-first[x] - second[y + 1], x, y + 1))
            if y == 0 and x + 1 < len(first):
                heapq.heappush(heap, (-first[x + 1] - second[0], x + 1, 0))
            i, j = a[x], b[y]
            if -sum_ <= seen and self.count[i, j]:
                met += int(self.count[i, j])
                last = -sum_
                shelves.update(range(self.shelf[i, j], self.shelf[i, j] + self.shelves[i, j]))
        return -END, sorted(shelves)


def _matrix(column: pa.Array, columns: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(len(column), columns).astype(np.int64)


def indexed(vectors: DataFrame, anchor: Column, scale: int = 256, entries: int = ENTRIES, sample: int = SAMPLE, shelf: int | None = None,
            id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Index, int]:
    """The written rows (uid, id, label, is_anchor, cell, vector), the index and the number of components."""
    kept = vectors.where(finite(vector_col) & F.col(label_col).isNotNull()).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("string").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"), F.col(vector_col).alias("vector"))
    columns = -(-width(vectors, vector_col) // 2) * 2
    taken = kept.select("vector", F.xxhash64("id", "vector").alias("h")).orderBy("h").limit(sample).collect()
    points = integers(pa.array([r.vector for r in taken], type=pa.list_(pa.float64())), scale, columns)
    spark = vectors.sparkSession
    books = [codebook(half, entries) for half in np.split(points, 2, axis=1)]
    shared = spark.sparkContext.broadcast(books)
    schema = "uid long, id long, label string, is_anchor boolean, i int, j int, r1 long, r2 long, vector binary"

    def assign(batches):
        from pyspark import TaskContext

        out, next_uid = arrow_schema(schema), TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows in slices(batch):
                x = integers(rows.column("vector"), scale, columns)
                (i, r1), (j, r2) = (nearest(half, book) for half, book in zip(np.split(x, 2, axis=1), shared.value))
                raw = [row.tobytes() for row in x.astype("<i4")]
                made = [np.arange(next_uid, next_uid + len(x)), *(rows.column(c) for c in ("id", "label", "is_anchor")), i, j, r1, r2, raw]
                next_uid += len(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(made, out)], schema=out)

    rows = materialize(kept.mapInArrow(assign, schema), "cells")
    counted = rows.groupBy("i", "j").agg(F.count(F.lit(1)), F.max("r1"), F.max("r2"))
    cells = list(map(tuple, counted.collect()))  # at most entries squared
    total = sum(c[2] for c in cells)
    return rows, Index(books, cells, shelf or max(256, min(SHELF, total // 64))), columns


def shelved(rows: DataFrame, index: Index) -> DataFrame:
    """The rows with their shelf; a row of a large cell goes to one of its shelves by its number."""
    spark = rows.sparkSession
    places = [(int(i), int(j), int(index.shelf[i, j]), int(index.shelves[i, j])) for i, j in zip(*np.nonzero(index.count))]
    directory = spark.createDataFrame(places, "i int, j int, first long, many long")  # at most entries squared
    return rows.join(F.broadcast(directory), ["i", "j"]).withColumn("shelf", F.col("first") + F.pmod(F.xxhash64("uid"), F.col("many")))


def first_in_windows(rows: DataFrame, index: Index, columns: int, anchors: DataFrame, same_label: bool, k: int, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """For each anchor and window (lows, highs) the first k rows by score, then id, of the same or of other labels.

    `anchors`: uid, label, vector, lows, highs. Result: uid, window, score, id, other (the row's uid), rank.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(index.plain)
    wide = "uid long, label string, vector binary, lows array<long>, highs array<long>"
    state = materialize(anchors.select("uid", "label", "vector", "lows", "highs", F.col("lows").alias("floors"), F.lit(END).alias("seen")), "anchors")
    shelves = shelved(rows, index).select("shelf", "uid", "label", "vector", F.lit(None).cast("array<long>").alias("floors"), F.lit(None).cast("array<long>").alias("highs"),
                                          F.lit(None).cast("long").alias("seen"), F.lit(None).cast("long").alias("until"), "id", "i", "j")
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    plan_fields = wide + ", floors array<long>, seen long, until long, shelves array<long>"
    plan_schema = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in plan_fields.split(", "))])
    best, met = None, first

    while not state.isEmpty():
        def walk(batches, met=met):
            at = Index(*shared.value)
            for batch in batches:
                for part in slices(batch, 256):
                    q = _matrix(part.column("vector"), columns)
                    bounds = [at.bounds(h, half) for h, half in enumerate(np.split(q, 2, axis=1))]
                    lows = [min((x for x, y in zip(lo, hi) if x <= y), default=END) for lo, hi in zip(part.column("floors").to_pylist(), part.column("highs").to_pylist())]
                    found = [at.walk(a, b, s, met, low) for a, b, s, low in zip(*bounds, part.column("seen").to_pylist(), lows)]
                    made = [part.column(c) for c in plan_schema.names[:-2]] + [[u for u, _ in found], [x for _, x in found]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(made, plan_schema)], schema=plan_schema)

        plan = materialize(state.select(*plan_schema.names[:-2]).mapInArrow(walk, plan_fields), "walks")
        visits = plan.select(F.explode("shelves").alias("shelf"), "uid", "label", "vector", "floors", "highs", "seen", "until",
                             F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j"))
        # Rows (they have an id) come before the visits of their shelf.
        met_rows = shelves.unionByName(visits).repartition("shelf").sortWithinPartitions("shelf", F.col("id").isNull())
        found = met_rows.mapInArrow(_scorer(shared, columns, same_label, k), "uid long, window int, score long, id long, other long")
        both = found if best is None else best.drop("rank").unionByName(found)
        order = Window.partitionBy("uid", "window").orderBy(F.desc("score"), "id", "other")
        best = materialize(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        # A window with k rows needs no row below the last of them.
        full = best.where(F.col("rank") == k).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("last"))
        full_floors = F.transform("lows", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("last", w), x)))
        next_state = plan.join(full, "uid", "left").withColumn("floors", full_floors).withColumn("seen", F.col("until"))
        # Open: some window that is not empty may still gain a row from cells whose bound reaches its floor.
        open_window = F.exists(F.arrays_zip("floors", "highs"), lambda z: (z["floors"] <= z["highs"]) & (z["floors"] <= F.col("until")))
        state = materialize(next_state.where((F.col("until") > -END) & open_window).select("uid", "label", "vector", "lows", "highs", "floors", "seen"), "anchors")
        met *= growth
    return best if best is not None else spark.createDataFrame([], "uid long, window int, score long, id long, other long, rank int")


def _scorer(shared, columns: int, same_label: bool, k: int):
    schema = arrow_schema("uid long, window int, score long, id long, other long")

    def run(batches):
        index, shelf, held, parts = Index(*shared.value), None, None, []
        for batch in batches:
            ids, shelf_of = batch.column("id"), batch.column("shelf").to_numpy()
            is_row = np.asarray(ids.is_valid())
            edges = np.nonzero((np.diff(shelf_of) != 0) | np.diff(is_row))[0] + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                if is_row[a]:
                    if shelf_of[a] != shelf:
                        shelf, parts = shelf_of[a], []
                    parts.append(part)
                    held = None
                    continue
                if shelf_of[a] != shelf:
                    continue
                if held is None:
                    rows = pa.Table.from_batches(parts)
                    held = _matrix(rows.column("vector"), columns), *(rows.column(c).to_numpy() for c in ("id", "i", "j", "uid")), np.array(rows.column("label").to_pylist(), dtype=object)
                for visits in slices(part, max(1, (1 << 20) // len(held[0]))):
                    yield from scored(index, held, visits)

    def scored(index, held, visits):
        x, ids, i, j, uids, labels = held
        q = _matrix(visits.column("vector"), columns)
        first, second = (index.bounds(h, half) for h, half in enumerate(np.split(q, 2, axis=1)))
        bound = first[:, i] + second[:, j]
        seen, until, anchor = (visits.column(c).to_numpy() for c in ("seen", "until", "uid"))
        names = np.array(visits.column("label").to_pylist(), dtype=object)
        fits = (names[:, None] == labels[None]) == same_label
        fits &= (bound <= seen[:, None]) & (bound > until[:, None]) & (anchor[:, None] != uids[None])
        score = dots(q, x)
        floors, highs = visits.column("floors").to_pylist(), visits.column("highs").to_pylist()
        for w in range(max(map(len, floors), default=0)):
            low = np.array([f[w] if w < len(f) else END for f in floors])
            high = np.array([h[w] if w < len(h) else -END for h in highs])
            at, row = np.nonzero(fits & (score >= low[:, None]) & (score <= high[:, None]))
            if not len(at):
                continue
            got = score[at, row]
            order = np.lexsort((ids[row], -got, at))
            at, row, got = at[order], row[order], got[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            keep = place < k
            at, row, got = at[keep], row[keep], got[keep]
            made = [anchor[at], np.full(len(at), w), got, ids[row], uids[row]]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(made, schema)], schema=schema)

    return run


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, shelf: int | None = None,
                   first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """For each anchor and each of its first positives the first rows of other labels that score `low` to `high` percent of the positive."""
    rows, index, columns = indexed(vectors, anchor, scale, entries, SAMPLE, shelf, id_col, vector_col, label_col)
    chosen = rows.where("is_anchor")
    every = chosen.select("uid", "label", "vector", F.array(F.lit(-END)).alias("lows"), F.array(F.lit(END)).alias("highs"))
    near = first_in_windows(rows, index, columns, every, True, positives, first, growth)

    def percent(p, share, up):
        x = p * (-share if up else share)
        whole = ((x - F.pmod(x, F.lit(100))) / 100).cast("long")
        return -whole if up else whole

    ranked = near.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))  # as many as positives
    wanted = chosen.join(ranked, "uid").select(
        "uid", "label", "vector", F.transform("p", lambda x: percent(x["score"], low, True)).alias("lows"), F.transform("p", lambda x: percent(x["score"], high, False)).alias("highs"))
    far = first_in_windows(rows, index, columns, wanted, False, negatives, first, growth)
    one = near.select("uid", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    two = far.select("uid", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return chosen.select("uid", F.col("id").alias("anchor_id")).join(one, "uid").join(two, ["uid", "window"]).select(
        "anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH rows AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 10
"""
