"""SimHash near duplicates by covering locality-sensitive hashing.

Every bit position has a vector of radius + 1 bits; table v drops the positions whose vector is
orthogonal to v. The at most `radius` differing positions of a pair span less than the whole space,
so some non-zero v is orthogonal to all of them, drops them, and the pair shares that table's key. There are
2^(radius+1) - 1 tables, and no pair within the radius is missed.

Copies collapse to one fingerprint first. A bucket larger than a block is cut into blocks by hash and
compared block by block in separate tasks; a task passes on a spanning forest of its links, not
all pairs.

Cases: a null or blank text has fingerprint zero and is linked like any other; fewer words than a
shingle give one shingle of all; repeated rows and ids keep a row each; a missing id never names a
component unless all its documents lack one; other columns are ignored; an empty table gives an
empty result; words of a long text are hashed in pieces.
"""

from __future__ import annotations

import sys
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktide.session import materialize

from .common import arrow_schema, keyed, map_batches, read, without
from .components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 64
SEED = 42
BLOCK = 1000


def shingle_hashes(text: str | None, width: int = 4):
    """Words of the text and pieces of the XXH64 hashes of its word shingles, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()  # ASCII letters and white space only
    joined, lengths = b" ".join(words), list(map(len, words))
    width = min(width, len(words))
    begins = [0, *accumulate(n + 1 for n in lengths)]
    total, digest, piece = len(words) - width + 1 if words else 0, xxhash.xxh64_intdigest, 1 << 16

    def pieces():
        for at in range(0, total, piece):
            last = min(total, at + piece)
            yield np.array([digest(joined[s:e - 1], SEED) for s, e in zip(begins[at:last], begins[at + width:last + width])], dtype="<u8")

    return joined, total, pieces()


def majority(pieces, total: int) -> int:
    """Bits set in over half the hashes; zero if there are none."""
    counts = np.zeros(BITS, dtype=np.int64)
    for hashes in pieces:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 4) -> int:
    _, total, pieces = shingle_hashes(text, width)
    return majority(pieces, total)


def covering_masks(radius: int) -> list[int]:
    """Bits kept by each table."""
    size = 1 << (radius + 1)
    vectors = [i % (size - 1) + 1 for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each linked point, a point of its group that stands for all connected with it."""
    n = len(points)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
    label = np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.nonzero(label != np.arange(n))[0]
    return points[at], points[label[at]]


def _linked(keys: np.ndarray, points: np.ndarray, radius: int, small: int = 12):
    """Links inside runs of equal keys."""
    starts = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1])
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    size_of = np.repeat(sizes, sizes)
    a, b = [], []
    for shift in range(1, small):
        same = (keys[shift:] == keys[:-shift]) & (size_of[shift:] <= small)
        at = np.nonzero(same)[0]
        at = at[np.bitwise_count(points[at] ^ points[at + shift]) <= radius]
        a.append(points[at])
        b.append(points[at + shift])
    for i in np.nonzero(sizes > small)[0]:
        x, y = _forest(points[starts[i]:starts[i] + sizes[i]], radius)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def near_links(prints: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Links `a`, `b` that connect all distinct values of `fp` within the radius; no more than a forest of each block."""
    masks = covering_masks(radius)
    tables = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks)])
    keys = prints.select("fp", F.explode(tables).alias("bucket"))
    busy = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block)
    # Spark counts the keys of a row as one row when it sizes this table, so neither side may be sent whole to the driver on that account.
    members = keys.hint("merge").join(busy, "bucket").select("bucket", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp", F.lit(7)), blocks).alias("own"))
    other = members.select("bucket", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    paired = other.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "fp")

    def run(batches):
        out = arrow_schema("a long, b long")
        held_keys, held_points = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def found(keys, points):
            if len(keys) > 1:
                a, b = _linked(keys, points.view(np.uint64), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], schema=out)

        for batch in batches:
            keys = np.concatenate([held_keys, batch.column(0).to_numpy()])
            points = np.concatenate([held_points, batch.column(1).to_numpy()])
            if not len(keys):
                continue
            cut = np.searchsorted(keys, keys[-1])
            yield from found(keys[:cut], points[:cut])
            held_keys, held_points = keys[cut:], points[cut:]
        yield from found(held_keys, held_points)

    return paired.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, id and th (see `keyed`) and fp of every text."""
    def make():
        def step(batch):
            prints = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            return batch.column("doc_id"), batch.column("id"), batch.column("th"), prints
        return step

    return map_batches(keyed(docs, id_col, text_col), make, "doc_id long, id long, th long, fp long")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, id, th, fp and component_id, the smallest id that links lead to."""
    prints = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(firsts.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.join(names, "root").select("fp", "component_id")
    # Every fingerprint has a component; an outer join, as in `keep_first`.
    return prints.join(by_print, "fp", "left").select("doc_id", "id", "th", "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows, with all their columns, of the document with the smallest id (then text hash) of each component.

    Rows that share id and text are one document and stay or go together.
    """
    prints = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    spot = F.struct("id", "th")
    ends = prints.groupBy("fp").agg(F.min(spot).alias("first"), F.max(spot).alias("last"))
    roots = components(near_links(ends.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = ends.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # One row for each fingerprint, so groups of exact copies are small here.
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"), F.max("last").alias("tail")).where("head != tail").select("root", "head")
    named = rooted.join(heads, "root").select("fp", "head")
    # An outer join, in which only `named` may be sent whole: files of repeated rows are far smaller than their rows.
    gone = prints.select("fp", "id", "th").join(named, "fp", "left").where(spot != F.coalesce("head", spot)).select("id", "th").distinct()
    return without(docs, gone, id_col, text_col)


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
