"""Vector codes: codebooks for each part of the vectors, fitted on metric trees of anchors.

Vectors are read once into blocks. A block has a tree of balls for each part, built from the middle: some
square root of its points become anchors (each new one is the point farthest from the widest anchor and
takes the points that are nearer to it), anchors are merged pair by pair into the balls above, and the
points of each anchor are treated the same way below. A ball keeps the sum and the number of its points.
A round of the fit walks down each tree with the list of codebook entries that can still be nearest to
some point of the ball; children inherit the list, and once one entry is left the ball is its own as a
whole and gives its sum and count without a look at its points. Only leaves compare points with what is
left of the list, in whole numbers. Spark adds the sums of all blocks; a codebook has a fixed size, so
it may pass the driver. No vector is shuffled or read by the driver but the first entries.

Cases: a null vector and one with a null, infinite or undefined component are dropped; shorter vectors are
filled up with zeros to the longest, and that to a multiple of the parts; rows without id come after all
others; repeated rows keep a row each; rows of one id are ordered by their vectors; with fewer rows than
entries the codebook is shorter; equal entries: the lower index; equal labels may be null; other columns
are ignored; an empty table gives an empty result; integer components of 2^26 and more are refused.
"""

from __future__ import annotations

import hashlib
import io
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktide.session import materialize

from .common import arrow_schema, read
from .vectors import exact_in_doubles, finite, integers, width

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4096  # rows of a block
LEAF = 32  # points of a ball that is not split


class Tree:
    """Balls over the points of a block; a ball's points are a range of `order`."""

    FIELDS = ("order", "range", "child", "centre", "radius", "total")

    def __init__(self, points: np.ndarray):
        self.points = points
        self._spans, self._child, self._order = [], [], []
        if len(points):
            self._build(np.arange(len(points)))
        self.order = np.array(self._order, dtype=np.int32)
        self.range = np.array(self._spans, dtype=np.int32).reshape(-1, 2)
        self.child = np.array(self._child, dtype=np.int32).reshape(-1, 2)
        held = points[self.order].astype(np.int64)
        sums = np.concatenate([np.zeros((1, points.shape[1]), dtype=np.int64), np.cumsum(held, axis=0)])
        self.total = sums[self.range[:, 1]] - sums[self.range[:, 0]]
        self.centre = self.total / np.maximum(1, np.diff(self.range, axis=1))
        spread = [np.sqrt(((held[a:b] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(self.range, self.centre)]
        self.radius = np.array(spread).reshape(-1) * (1 + 1e-12)

    def _ball(self, children=(-1, -1)) -> int:
        self._spans.append([0, 0])
        self._child.append(list(children))
        return len(self._spans) - 1

    def _leaf(self, at: np.ndarray) -> int:
        ball = self._ball()
        self._spans[ball] = [len(self._order), len(self._order) + len(at)]
        self._order.extend(at.tolist())
        return ball

    def _build(self, at: np.ndarray) -> int:
        """The ball of the points `at`: anchors in the middle, merged upwards, split downwards."""
        if len(at) <= LEAF:
            return self._leaf(at)
        groups = anchors(self.points[at].astype(np.float64), int(np.ceil(np.sqrt(len(at)))))
        if len(groups) == 1:  # all points are equal
            return self._leaf(at)
        return self._lay(merged(self.points, [at[g] for g in groups]))

    def _lay(self, plan) -> int:
        """Balls of a merge plan, left before right, so that each covers a range."""
        if isinstance(plan, np.ndarray):
            return self._build(plan)
        first = len(self._order)
        left = self._lay(plan[0])
        right = self._lay(plan[1])
        ball = self._ball((left, right))
        self._spans[ball] = [first, len(self._order)]
        return ball

    def arrays(self) -> dict:
        return {f: getattr(self, f) for f in self.FIELDS}

    @classmethod
    def of(cls, points: np.ndarray, arrays: dict) -> Tree:
        tree = cls.__new__(cls)
        tree.points = points
        for f in cls.FIELDS:
            setattr(tree, f, arrays[f])
        return tree

    def nearest(self, entries: np.ndarray, by_ball: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest entry of each point, and the number and sum of points of each entry.

        `by_ball` collects the sizes of the balls that went to one entry as a whole.
        """
        found = np.zeros(len(self.points), dtype=np.int64)
        count, total = np.zeros(len(entries), dtype=np.int64), np.zeros(entries.shape, dtype=np.int64)
        first: dict[bytes, int] = {}
        for i, e in enumerate(entries):
            first.setdefault(e.tobytes(), i)
        work = [(len(self.range) - 1, np.array(sorted(first.values())))] if len(self.range) else []
        real, looked = entries.astype(np.float64), [np.zeros(0, dtype=np.int32)]
        while work:
            ball, left = work.pop()
            a, b = self.range[ball]
            if len(left) > 1:
                away = ((real[left] - self.centre[ball]) ** 2).sum(axis=1)
                best = int(np.argmin(away))
                apart = np.sqrt(((real[left] - real[left[best]]) ** 2).sum(axis=1))
                # Farther than the best for every point of the ball: the difference of squares is linear in the point.
                lost = away[best] - away + 2 * self.radius[ball] * apart < -1e-9 * (1 + away + away[best])
                left = left[~lost]
            if len(left) == 1:
                entry = left[0]
                found[self.order[a:b]] = entry
                count[entry] += b - a
                total[entry] += self.total[ball]
                if by_ball is not None:
                    by_ball.append(int(b - a))
            elif self.child[ball, 0] < 0:
                at = self.order[a:b]
                found[at] = left[np.argmin(squares(self.points[at], entries[left]), axis=1)]
                looked.append(at)
            else:
                work += [(self.child[ball, 0], left), (self.child[ball, 1], left)]
        at = np.concatenate(looked)
        count += np.bincount(found[at], minlength=len(entries))
        np.add.at(total, found[at], self.points[at])
        return found, count, total


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries."""
    if exact_in_doubles(points, entries):
        x, e = points.astype(np.float64), entries.astype(np.float64)
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ e.T) + (e * e).sum(axis=1)
    return ((points[:, None, :].astype(np.int64) - entries[None]) ** 2).sum(axis=2)


def anchors(points: np.ndarray, count: int) -> list[np.ndarray]:
    """Places of the points of each anchor; fewer than `count` if there are fewer different points."""
    owner = np.zeros(len(points), dtype=np.int64)
    chosen = [points[0]]
    away = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    while len(chosen) < count:
        far = int(np.argmax(away))  # the farthest point of the widest anchor
        if away[far] == 0:
            break
        new = points[far]
        gap = np.sqrt(((np.array(chosen) - new) ** 2).sum(axis=1))
        near = np.nonzero(away > gap[owner] / 2 * (1 - 1e-9))[0]  # no other point can be nearer to the new anchor
        to_new = np.sqrt(((points[near] - new) ** 2).sum(axis=1))
        won = to_new < away[near]
        owner[near[won]], away[near[won]] = len(chosen), to_new[won]
        chosen.append(new)
    return [g for g in (np.nonzero(owner == k)[0] for k in range(len(chosen))) if len(g)]


def merged(points: np.ndarray, groups: list[np.ndarray]):
    """Nested pairs of groups: the two balls whose common ball is smallest are merged first."""
    plans = list(groups)
    size = np.array([len(g) for g in groups], dtype=np.float64)
    centre = np.array([points[g].mean(axis=0) for g in groups]).reshape(len(groups), -1)
    radius = np.array([np.sqrt(((points[g] - c) ** 2).sum(axis=1).max()) for g, c in zip(groups, centre)])
    gap = np.sqrt(np.maximum(0, ((centre[:, None] - centre[None]) ** 2).sum(axis=2)))
    cost = (gap + radius[:, None] + radius[None]) / 2
    cost = np.maximum(cost, np.maximum(radius[:, None], radius[None]))
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(groups) - 1):
        i, j = sorted(map(int, np.unravel_index(np.argmin(cost), cost.shape)))
        plans[i] = (plans[i], plans[j])
        middle = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
        radius[i] = max(np.linalg.norm(centre[k] - middle) + radius[k] for k in (i, j))
        centre[i] = middle
        size[i] += size[j]
        alive = np.isfinite(cost).any(axis=1)
        alive[[i, j]] = False
        away = np.sqrt(((centre - middle) ** 2).sum(axis=1))
        row = np.where(alive, np.maximum((away + radius + radius[i]) / 2, np.maximum(radius, radius[i])), np.inf)
        cost[i], cost[:, i], cost[j], cost[:, j] = row, row, np.inf, np.inf
        last = plans[i]
    return last


def trees(vectors: DataFrame, scale: int = 1024, parts: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
          block: int = BLOCK) -> DataFrame:
    """The written blocks: ids, labels, and one blob with the integer vectors and the trees of their parts."""
    kept = vectors.where(finite(vector_col)).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    columns = -(-width(vectors, vector_col) // parts) * parts
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("blob", pa.binary())])

    def run(batches):
        held: list[pa.RecordBatch] = []

        def blocks(last):
            table = pa.Table.from_batches(held)
            full = table.num_rows if last else table.num_rows // block * block
            for start in range(0, full, block):
                yield table.slice(start, min(block, full - start)).combine_chunks()
            held[:] = table.slice(full).to_batches()

        def built(table):
            x = integers(table.column("vector"), scale, columns).astype(np.int32)
            arrays = {"x": x}
            for p, part in enumerate(np.split(x, parts, axis=1)):
                arrays |= {f"{p}{f}": a for f, a in Tree(part).arrays().items()}
            out = io.BytesIO()
            np.savez(out, **arrays)
            return pa.RecordBatch.from_arrays([pa.array([table.column("id").to_pylist()], type=schema.field(0).type),
                                               pa.array([table.column("label").to_pylist()], type=schema.field(1).type), pa.array([out.getvalue()])], schema=schema)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= block:
                yield from map(built, blocks(False))
        if held and sum(b.num_rows for b in held):
            yield from map(built, blocks(True))

    return materialize(kept.mapInArrow(run, "ids array<long>, labels array<string>, blob binary"), "trees")


def opened(blob: bytes, parts: int) -> list[Tree]:
    with np.load(io.BytesIO(blob)) as f:
        x = f["x"]
        return [Tree.of(part, {n: f[f"{p}{n}"] for n in Tree.FIELDS}) for p, part in enumerate(np.split(x, parts, axis=1))]


def first_entries(vectors: DataFrame, entries: int = 256, scale: int = 1024, parts: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> list[np.ndarray]:
    """The parts of the rows with the smallest ids, a codebook for each part."""
    columns = -(-width(vectors, vector_col) // parts) * parts
    rows = vectors.where(finite(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).orderBy(
        F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    x = integers(pa.array([r.v for r in rows], type=pa.list_(pa.float64())), scale, columns)
    return np.split(x, parts, axis=1)


def refined(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every part to its nearest entry, every used entry to the floor of the mean of its parts."""
    shared, parts = blocks.sparkSession.sparkContext.broadcast(books), len(books)
    schema = "part int, entry int, n long, sums array<long>"

    def run(batches):
        count = [np.zeros(len(b), dtype=np.int64) for b in shared.value]
        total = [np.zeros(b.shape, dtype=np.int64) for b in shared.value]
        for batch in batches:
            for blob in batch.column("blob"):
                for p, tree in enumerate(opened(blob.as_py(), parts)):
                    _, n, sums = tree.nearest(shared.value[p])
                    count[p] += n
                    total[p] += sums
        rows = [(p, e, int(count[p][e]), total[p][e].tolist()) for p in range(parts) for e in np.nonzero(count[p])[0].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, arrow_schema(schema))], schema=arrow_schema(schema))

    sums = blocks.select("blob").mapInArrow(run, schema)
    added = sums.select("part", "entry", "n", F.posexplode_outer("sums").alias("at", "value")).groupBy("part", "entry", "at").agg(
        F.sum("n").alias("n"), F.sum("value").alias("value"))
    new = [b.copy() for b in books]
    for r in added.collect():  # a row for each component of the codebooks
        if r["at"] is not None:
            new[r.part][r.entry, r["at"]] = r.value // r.n
    return new


def encoded(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (hexadecimal entry numbers in part order) and error (squared distances summed) of every row."""
    shared, parts = blocks.sparkSession.sparkContext.broadcast(books), len(books)
    schema = "vec_id long, label string, code string, error long"

    def run(batches):
        out = arrow_schema(schema)
        for batch in batches:
            for ids, labels, blob in zip(*(batch.column(c) for c in ("ids", "labels", "blob"))):
                error, digits = np.zeros(len(ids), dtype=np.int64), []
                for tree, book in zip(opened(blob.as_py(), parts), shared.value):
                    found = tree.nearest(book)[0]
                    error += ((tree.points.astype(np.int64) - book[found]) ** 2).sum(axis=1)
                    digits.append(found)
                codes = [bytes(row).hex() for row in np.array(digits, dtype=np.uint8).T]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(codes, type=pa.string()), pa.array(error)], schema=out)

    return blocks.mapInArrow(run, schema)


def codes(vectors: DataFrame, entries: int = 256, rounds: int = 4, scale: int = 1024, parts: int = 4, id_col: str = "vec_id", vector_col: str = "embedding",
          label_col: str = "label", block: int = BLOCK) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes and errors of all rows, and the codebooks after `rounds` rounds; at most 256 entries."""
    blocks = trees(vectors, scale, parts, id_col, vector_col, label_col, block)
    books = first_entries(vectors, entries, scale, parts, id_col, vector_col)
    for _ in range(rounds if len(books[0]) else 0):
        books = refined(blocks, books)
    return encoded(blocks, books), books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


# DuckDB's words for the same fit; a round assigns the parts to the entries and floors the means.
_ROUND = """
a{k} AS (SELECT p, vec_id, min({{'d': list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), 'e': e}}) AS best
         FROM parts JOIN c{j} USING (p) GROUP BY p, vec_id),
m{k} AS (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS v FROM parts JOIN (SELECT p, vec_id, best.e AS e FROM a{k}) USING (p, vec_id), range(1, 17) t(i) GROUP BY p, e, i),
c{k} AS (SELECT p, e, coalesce(n, c) AS c FROM c{j} LEFT JOIN (SELECT p, e, list(v ORDER BY i) AS n FROM m{k} GROUP BY p, e) USING (p, e)),"""

ORACLE_SQL = """
WITH kept AS (
  SELECT vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * 16 + 1:p * 16 + 16] AS x FROM kept, range(4) t(p)),
c0 AS (SELECT p, e, c FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts) WHERE e < 256),""" + "".join(
    _ROUND.format(j=k - 1, k=k).replace(f"a{k} AS (", f"a{k} AS MATERIALIZED (").replace(f"c{k} AS (", f"c{k} AS MATERIALIZED (") for k in range(1, 5)) + """
last AS (SELECT p, vec_id, min({'d': list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), 'e': e}) AS best
         FROM parts JOIN c4 USING (p) GROUP BY p, vec_id),
rows AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM last GROUP BY vec_id),
held AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM c4))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM rows JOIN kept USING (vec_id), held
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = codes(read(spark, sf_dir, "embeddings"))
    rows = materialize(found, "vector_codes")
    sums = materialize(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    other = sums.select(F.col("label").alias("other"), "label_error")
    return rows.join(other, F.col("label").eqNullSafe(F.col("other"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
