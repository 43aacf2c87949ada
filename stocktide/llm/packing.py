"""Packing of documents into sequences by length patterns and non-negative least squares.

Only the histogram of lengths is needed to plan: lengths are put into bins (rounded up), patterns of a
few bins that fill a sequence are enumerated, and repeat counts of the patterns are fitted to the
histogram by non-negative least squares and rounded down. What the patterns leave over is put, longest
first, into the tightest room that is left, whole runs of equal lengths at a time. The plan is a list of
sequence classes ("so many sequences that hold these lengths"), whose size hangs on the capacity and not
on the number of documents. Every piece has a rank among the pieces of its length, counted by task and
offset by the counts of the tasks before; plan and rank together give its sequence and offset, so no
document is moved and no length, however common, meets in one task.

Cases: a null text is empty and holds the end id alone; a document longer than a sequence is cut into
full pieces, the last may be shorter; documents without id and repeated rows are packed row by row;
pieces of equal length are interchangeable, their order is that of the written pieces; other columns are
ignored; an empty table gives an empty result. A text needs the memory of its own ids in one task.
"""

from __future__ import annotations

import bisect
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stocktide.session import materialize

from . import bpe
from .common import arrow_schema, identified, read, slices
from .sequences import WordEncoder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# (bins, documents of a pattern): the fits that are tried until one needs no more sequences than the tokens fill.
FITS = ((64, 4), (64, 3), (64, 2), (128, 3))
_RANKS = 1 << 44  # more pieces of one length than this are not expected


def patterns(bins: int, most: int) -> list[tuple[int, ...]]:
    """Bin numbers, largest first, of all patterns of at most `most` documents that add up to `bins`."""
    def parts(total, largest, left):
        if total == 0:
            yield ()
        elif left:
            for first in range(min(total, largest), (total - 1) // left, -1):
                for rest in parts(total - first, first, left - 1):
                    yield (first, *rest)

    return list(parts(bins, bins, most))


def nonnegative_fit(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 with the least squared error of a x against b, by active sets."""
    gram, aim = a.T @ a, a.T @ b
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    close = 1e-9 * max(1.0, float(np.abs(aim).max(initial=0)))
    for _ in range(rounds):
        slope = np.where(used, -np.inf, aim - gram @ x)
        best = int(np.argmax(slope))
        if slope[best] <= close:
            break
        used[best] = True
        while True:
            at = np.nonzero(used)[0]
            trial = np.linalg.lstsq(gram[np.ix_(at, at)], aim[at], rcond=None)[0]
            if (trial > 0).all():
                x[:] = 0
                x[at] = trial
                break
            low = trial <= 0
            old = x[at]
            step = float(np.min(old[low] / np.maximum(old[low] - trial[low], 1e-300)))
            x[at] = old + step * (trial - old)
            used[at[low & (x[at] <= 1e-12)]] = False
            x[~used] = 0
            if not used.any():
                break
    return x


class Room:
    """Sequence classes by the room that is left in them."""

    def __init__(self):
        self.of: dict[int, list] = {}
        self.sizes: list[int] = []

    def add(self, room: int, count: int, held: tuple) -> None:
        if room not in self.of:
            self.of[room] = []
            bisect.insort(self.sizes, room)
        self.of[room].append((count, held))

    def tightest(self, length: int):
        at = bisect.bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        room = self.sizes[at]
        count, held = self.of[room].pop()
        if not self.of[room]:
            del self.of[room], self.sizes[at]
        return room, count, held


def plan(histogram: dict[int, int], capacity: int, fits=FITS) -> list[tuple[int, tuple]]:
    """(number of sequences, ((length, how many in each), ...)) for all lengths of the histogram: the fit with the fewest sequences."""
    least, best, fewest = -(-sum(n * c for n, c in histogram.items()) // capacity), None, None
    for bins, most in fits:
        found = fitted(histogram, capacity, bins, most)
        count = sum(c for c, _ in found)
        if best is None or count < fewest:
            best, fewest = found, count
        if fewest == least:
            break
    return best


def fitted(histogram: dict[int, int], capacity: int, bins: int, most: int) -> list[tuple[int, tuple]]:
    """The plan by patterns of at most `most` documents, whose lengths are told apart by `bins`."""
    left = {n: c for n, c in histogram.items() if c}
    room = Room()
    width = -(-capacity // bins)
    by_bin: dict[int, list[int]] = {}
    for n in sorted(left):
        by_bin.setdefault(-(-n // width), []).append(n)
    total = sum(left.values())
    if total:
        found = [p for p in patterns(-(-capacity // width), most) if all(b in by_bin for b in p)]
        counts = {b: sum(left[n] for n in ns) for b, ns in by_bin.items()}
        row = {b: i for i, b in enumerate(sorted(by_bin))}
        a = np.zeros((len(row), len(found)))
        for k, p in enumerate(found):
            for b in p:
                a[row[b], k] += 1
        # Long documents are the ones that are hard to place later: their residuals weigh more.
        weight = np.array([b / max(row) for b in sorted(by_bin)])
        share = np.array([counts[b] / total for b in sorted(by_bin)])
        times = nonnegative_fit(a * weight[:, None], share * weight) * total if found else []
        for k in sorted(range(len(found)), key=lambda k: (-len(found[k]), -times[k])):
            _draw(found[k], int(times[k] + 1e-6), by_bin, left, room, capacity)
    for n in sorted(left, reverse=True):
        rest = left[n]
        while rest:
            size, count, held = room.tightest(n) or (capacity, -(-rest // (capacity // n)), ())
            each = size // n
            filled = min(count, rest // each)
            if filled:
                room.add(size - each * n, filled, (*held, (n, each)))
                rest -= filled * each
                if count > filled:
                    room.add(size, count - filled, held) if held else None
            else:
                room.add(size - rest * n, 1, (*held, (n, rest)))
                if count > 1:
                    room.add(size, count - 1, held)
                rest = 0
    return [x for size in room.sizes for x in room.of[size]]


def _draw(pattern, repeat, by_bin, left, room, capacity) -> None:
    """Take lengths for `repeat` sequences of a pattern; its last place takes the longest that fits in what is left."""
    lengths = sorted(left)
    while repeat:
        uses: dict[int, int] = {}
        for b in pattern[:-1]:
            n = next((n for n in reversed(by_bin[b]) if left.get(n, 0) > uses.get(n, 0)), None)
            if n is None:
                return
            uses[n] = uses.get(n, 0) + 1
        space = capacity - sum(n * m for n, m in uses.items())
        at = bisect.bisect_right(lengths, space) - 1
        while at >= 0 and left[lengths[at]] <= uses.get(lengths[at], 0):
            at -= 1
        if at < 0:
            return
        uses[lengths[at]] = uses.get(lengths[at], 0) + 1
        times = min([repeat, *(left[n] // m for n, m in uses.items())])
        repeat -= times
        for n, m in uses.items():
            left[n] -= times * m
            if not left[n]:
                lengths.remove(n)
                del left[n]
                next(ns for ns in by_bin.values() if n in ns).remove(n)
        room.add(capacity - sum(n * m for n, m in uses.items()), times, tuple(uses.items()))


class Places:
    """Sequence and offset of a piece by its length and its rank among the pieces of that length."""

    def __init__(self, classes):
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for count, held in classes:
            offset = 0
            for n, each in held:
                rows.append((n * _RANKS + used.get(n, 0), n, used.get(n, 0), sequence, each, offset))
                used[n] = used.get(n, 0) + count * each
                offset += n * each
            sequence += count
        self.table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.table[:, 0], lengths * _RANKS + ranks, side="right") - 1
        _, _, first, sequence, each, offset = self.table[at].T
        place = ranks - first
        return sequence + place // each, offset + place % each * lengths


def cut(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1, with_ids: bool = False,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written pieces, each with its rank among the pieces of its length in its part of the table."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe.read_text(tokenizer or bpe.default_path("word_bpe_49k.json")))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long" + ", ids binary" * with_ids

    def run(batches):
        from pyspark import TaskContext

        encoder, out = WordEncoder.shared(shared.value), arrow_schema(schema)
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for rows in slices(batch):
                columns = tuple([] for _ in out)
                for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    ids = np.append(np.frombuffer(encoder.ids(text or ""), dtype=encoder.kind).astype("<u4"), np.uint32(end_id))
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        raw = ids[start:start + capacity].tobytes()
                        n = len(raw) // 4
                        for column, value in zip(columns, (doc, piece, start, n, zlib.crc32(raw), part, seen[n], raw)):
                            column.append(value)
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)

    return materialize(identified(docs, id_col, text_col).mapInArrow(run, schema), "pieces")


def packed(pieces: DataFrame, capacity: int = 4096, fits=FITS) -> DataFrame:
    """The pieces of `cut` with sequence_id and offset."""
    counts = materialize(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece_counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = pieces.sparkSession.sparkContext.broadcast(Places(plan(histogram, capacity, fits)).table)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    extra = [c for c in pieces.columns if c == "ids"]
    ranked = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", *extra, (F.col("before") + F.col("rank")).alias("rank"))
    kept = ranked.columns[:-1]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank").replace("bigint", "long") + ", sequence_id long, offset long"

    def run(batches):
        lookup, out = Places([]), arrow_schema(schema)
        lookup.table = places.value
        for batch in batches:
            sequence, offset = lookup.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], schema=out)

    return ranked.mapInArrow(run, schema)


def sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sequence_id, input_ids (little-endian 32-bit) and the lengths of the pieces in it, in order."""
    rows = packed(cut(docs, tokenizer, capacity, end_id, True, id_col, text_col), capacity)
    held = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))  # at most `capacity` pieces
    grouped = rows.groupBy("sequence_id").agg(held.alias("held"))
    return grouped.select("sequence_id", F.aggregate("held.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("input_ids"), F.col("held.length").alias("lengths"))


def op11_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(cut(read(spark, sf_dir)))
