"""Bytes covered by strings of a given length that also start earlier, over all documents.

Every window of `length` bytes holds an anchor: a short string whose hash is the least in the window, so
equal windows hold the same anchor at the same place. Occurrences of an anchor meet in one shuffle of
small rows: the hash of the anchor and of its surroundings (all windows that hold it). An occurrence
whose surroundings came before is removed as a whole. What remains are anchors with differing surroundings,
mostly the rims of repeated passages. Their bytes are fetched and every anchor grows: a window reaches half
of what it can to the left of its anchor, or half to the right, so it holds the anchor with that half, and
the occurrences of an anchor part by these grown anchors. Each task builds, for many grown anchors
together, a run-compressed Burrows-Wheeler index with sampled run ends of the earlier occurrences and
streams the later ones over it; a matching statistic of a whole window marks it. "Earlier" is settled by
halving: occurrences in odd blocks of 1, 2, 4, ... stream over the block before them. The grown anchor is one
symbol of its own, so no match leaves its anchor. One with more occurrences than a task should hold is
split by the place of the windows: those that begin 0-9, 10-19, ... bytes before it share still more
bytes, so each range groups by these and is handled as an anchor of its own.
What is too large even then goes on as single windows, whose first places are aggregated by hash.

Cases: a null text is empty; a text shorter than `length` is kept; rows that repeat id and text are one
document and each gets its result; a missing id counts as the largest; other columns are ignored; an
empty table gives an empty result; long texts are read in overlapping pieces.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stocktide.session import materialize

from .common import arrow_schema, bounded, cut_out, keyed, map_batches, read
from .suffixes import RunIndex
from .words import mixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, ANCHOR = 100, 24
BUNDLE = 8192  # occurrences in one index
VARIANTS = 4096  # occurrences of a grown anchor that one index takes; at most BUNDLE
RANGE = 10  # window starts that stay together when a large anchor is split
PIECE = 2 << 20


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """Best of each `width` consecutive values."""
    step = 1
    while 2 * step <= width:
        x = best(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return best(x[:-rest], x[rest:]) if rest else x


def anchor_places(raw: bytes, borders: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors in joined texts; no window crosses a border (ends of the texts)."""
    data = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
    n = len(data)
    if n < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    two = data[:-1] | data[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    h = mixed(mixed(mixed(eight[:-16]) + eight[8:-8]) + eight[16:])  # of 24 bytes
    width = length - ANCHOR + 1
    low = _sliding(h, width, np.minimum)
    starts = np.arange(len(low))
    inside = borders[np.searchsorted(borders, starts, side="right")] >= starts + length
    low = np.where(inside, low, 0)
    padded = np.concatenate([np.zeros(width - 1, dtype=np.uint64), low, np.zeros(width - 1, dtype=np.uint64)])
    at = np.nonzero((_sliding(padded, width, np.maximum) == h) & (h > 0))[0]
    return at, h[at]


def anchors_of(texts: list[bytes], length: int):
    """(text number, place, hash) of all anchors."""
    for low, high in bounded(texts, PIECE):
        if len(texts[low]) > 2 * PIECE:
            raw, places, hashes = texts[low], [], []
            for start in range(0, len(raw), PIECE):
                part = raw[start:start + PIECE + length - 1]
                at, h = anchor_places(part, np.array([len(part)]), length)
                places.append(at + start)
                hashes.append(h)
            at, first = np.unique(np.concatenate(places), return_index=True)
            yield np.full(len(at), low), at, np.concatenate(hashes)[first]
            continue
        borders = np.cumsum([len(t) for t in texts[low:high]])
        at, h = anchor_places(b"".join(texts[low:high]), borders, length)
        owner = np.searchsorted(borders, at, side="right")
        yield owner + low, at - np.concatenate([[0], borders])[owner], h


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    """a (anchor), s (surroundings), id, at (hash of the text and place)."""
    reach = length - ANCHOR

    def make():
        import xxhash

        digest = xxhash.xxh3_64_intdigest

        def step(batch):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            out = ([], [], [], [])
            for owner, at, h in anchors_of(texts, length):
                around = np.array([digest(texts[o][max(0, p - reach):p + length], min(p, reach)) for o, p in zip(owner.tolist(), at.tolist())], dtype=np.uint64)
                for column, value in zip(out, (h.view(np.int64), around.view(np.int64), ids[owner], tags[owner] << 32 | at)):
                    column.append(value)
            return [np.concatenate(c) for c in out] if out[0] else None

        return step

    return map_batches(rows.select("id", "tag", "text"), make, "a long, s long, id long, at long")


def _surroundings(rows: DataFrame, wanted: DataFrame, length: int, schema: str, each) -> DataFrame:
    """What `each(raw, places, keys)` yields for the wanted places (id, at, key) of every document."""
    places = wanted.groupBy("id", F.shiftright("at", 32).alias("tag")).agg(
        F.collect_list(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))).alias("places"), F.collect_list("a").alias("keys"))
    joined = rows.join(places, ["id", "tag"]).select("id", "tag", "text", "places", "keys")

    def make():
        def step(batch):
            names = [f.split()[0] for f in schema.split(",")]
            out = tuple([] for _ in names)
            for key, tag, text, places, keys in zip(*(batch.column(i).to_pylist() for i in range(5))):
                for row in each(text.encode(), places, keys):
                    for column, value in zip(out, (key, tag << 32 | row[0], *row[1:])):
                        column.append(value)
            return out
        return step

    return map_batches(joined, make, schema)


def bundle_marks(groups: np.ndarray, lefts: list[bytes], rights: list[bytes], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(occurrence, start relative to its anchor) of windows that an earlier occurrence of the same group has.

    Occurrences of a group stand together, in order; `lefts` and `rights` are the bytes around the anchor,
    of which a window holds `reach`.
    """
    n = len(groups)
    first = np.nonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))[0]
    sizes = np.diff(np.append(first, n))
    group, index = np.repeat(first, sizes), np.arange(n) - np.repeat(first, sizes)
    # A row for each occurrence: bytes to the left, anchor, bytes to the right, closing symbol; negative: none.
    flat = b"".join([left.rjust(reach, b"\0") + b"\0" + right.ljust(reach + 1, b"\0") for left, right in zip(lefts, rights)])
    rows = np.frombuffer(flat, dtype=np.uint8).reshape(n, 2 * reach + 2)
    starts, places = np.arange(reach + 1), np.arange(2 * reach + 2)
    low, high = reach - np.array([len(x) for x in lefts]), np.array([len(x) for x in rights])
    open_ = (starts >= low[:, None]) & (starts <= high[:, None])  # windows that no earlier occurrence is known to have
    marked = np.zeros_like(open_)
    # The windows of a range share bytes: a number for these and the group.
    ranges = []
    for begin in range(0, reach + 1, RANGE):
        end = min(begin + RANGE, reach + 1)
        shared = np.hstack([group[:, None].astype(np.int32).view(np.uint8), rows[:, end - 1:begin + reach + 1]])
        ranges.append((slice(begin, end), np.unique(shared.view(f"V{shared.shape[1]}").ravel(), return_inverse=True)[1]))
    # Large blocks first: a window that is settled is neither indexed nor streamed again, for whoever has it later meets its first occurrence.
    for level in reversed(range(int(max(sizes.max() - 1, 0)).bit_length())):
        odd = (index >> level & 1).astype(bool)
        family = group + (index >> level + 1 << level + 1)
        wanted = open_.copy()
        for columns, number in ranges:  # only what both blocks have can match
            have = np.nonzero(open_[:, columns].any(axis=1))[0]
            _, which = np.unique(number[have] * n + family[have], return_inverse=True)
            sides = np.zeros((2, len(have)), dtype=bool)
            sides[odd[have].astype(int), which] = True
            wanted[have, columns] &= sides.all(axis=0)[which][:, None]
        use = np.nonzero(wanted.any(axis=1))[0]
        if not len(use):
            continue
        table, later = rows[use].astype(np.int64), odd[use]
        left, right = wanted[use].argmax(axis=1), 2 * reach - wanted[use][:, ::-1].argmax(axis=1)
        table[(places < left[:, None]) | (places > right[:, None])] = -1
        table[:, reach] = 256 + family[use]  # blocks that meet have one anchor symbol
        members = table[~later]
        members[:, -1] = 256 + n + np.arange(len(members))
        text = members[members >= 0]
        used = np.zeros(256 + n + len(members), dtype=bool)
        used[text] = True
        symbol = np.append(np.where(used, np.cumsum(used) - 1, -2), -1)  # symbols without gaps; -2: not in the index, the last entry is for "none"
        made = RunIndex(symbol[text])
        for part in np.array_split(np.nonzero(later)[0], max(1, int(later.sum()) // 4096)):
            found = made.matching_statistics(symbol[table[part, :-1]], reach) > reach
            marked[use[part]] |= found
            open_[use[part]] &= ~found
    who, where = np.nonzero(marked)
    return who, where - reach


def _halves(length: int) -> tuple[int, int, int]:
    """Bytes by which an anchor grows, bytes of the grown anchor, and bytes of a window beyond it."""
    half = (length - ANCHOR) // 2
    return half, ANCHOR + half, length - ANCHOR - half


def _grown(around: DataFrame, length: int) -> DataFrame:
    """Occurrences of anchors grown to the left and of those grown to the right, where they have company.

    A window belongs to the left one if it holds the whole left half, otherwise to the right one.
    """
    half, _, rest = _halves(length)
    sides = F.explode(F.array(
        F.struct((F.length("left") >= half).alias("held"), (F.col("at") - half).alias("at"),
                 F.xxhash64("a", F.lit("left"), F.expr(f"substring(left, length(left) - {half - 1}, {half})")).alias("a"),
                 F.expr(f"substring(left, 1, length(left) - {half})").alias("left"), F.expr(f"substring(right, 1, {rest})").alias("right")),
        F.struct((F.length("right") >= half).alias("held"), F.col("at"),
                 F.xxhash64("a", F.lit("right"), F.expr(f"substring(right, 1, {half})")).alias("a"),
                 F.expr(f"substring(left, greatest(1, length(left) - {half - 2}), {half - 1})").alias("left"), F.expr(f"substring(right, {half + 1})").alias("right"))))
    grown = around.select("id", sides.alias("side")).select("id", "side.*").where(F.col("held") & (F.length("left") + F.length("right") >= rest)).drop("held")
    group = Window.partitionBy("a").orderBy("id", "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return grown.repartition("a").withColumn("size", F.count("*").over(group)).where("size > 1").sortWithinPartitions("a", "id", "at")


def _compared(live: DataFrame, length: int, variants: int, last: bool) -> DataFrame:
    """id, at (start) and size of ranges of windows that an earlier occurrence of the grown anchor has.

    Of an anchor with more than `variants` occurrences, the occurrences come instead with `a`, `left` and
    `right`; when `last`, their windows with a hash `h`.
    """
    schema = "id long, at long, size int, h long, a long, left binary, right binary"
    _, _, reach = _halves(length)

    def indexed(table: pa.Table):
        who, where = bundle_marks(table.column("a").to_numpy(), table.column("left").to_pylist(), table.column("right").to_pylist(), reach)
        if not len(who):
            return
        # windows that follow each other make one range
        begin = np.concatenate([[True], (who[1:] != who[:-1]) | (where[1:] > where[:-1] + 1)])
        low = np.nonzero(begin)[0]
        high = np.append(low[1:], len(who)) - 1
        ids, at = table.column("id").to_numpy(), table.column("at").to_numpy()
        yield ids[who[low]], at[who[low]] + where[low], where[high] - where[low] + length, *[[None] * len(low)] * 4

    def windows(table: pa.Table):
        import xxhash

        out = ([], [], [], [])
        for a, key, at, left, right in zip(*(table.column(c).to_pylist() for c in ("a", "id", "at", "left", "right"))):
            n = len(left)
            for o in range(max(0, reach - len(right)), min(reach, n) + 1):
                h = xxhash.xxh3_64_intdigest(left[n - o:] + b"%d:%d:" % (a, o) + right[:reach - o])
                for column, value in zip(out, (key, at - o, length, h - (1 << 64) if h >= 1 << 63 else h)):
                    column.append(value)
        yield *out, *[[None] * len(out[0])] * 3

    def onward(table: pa.Table):
        empty = [None] * table.num_rows
        yield *(table.column(c).combine_chunks() for c in ("id", "at")), empty, empty, *(table.column(c).combine_chunks() for c in ("a", "left", "right"))

    def run(batches):
        out, held = arrow_schema(schema), None

        def found(table: pa.Table):
            large = np.array(table.column("size").to_numpy() > variants)
            for part, use in ((table.filter(pa.array(~large)), indexed), (table.filter(pa.array(large)), windows if last else onward)):
                for columns in use(part) if part.num_rows else ():
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows > BUNDLE:
                keys = held.column("a").to_numpy()
                change = np.nonzero(keys[1:] != keys[:-1])[0] + 1
                change = change[change <= BUNDLE]
                # a part of a large group may go alone: its windows meet in Spark
                cut = change[-1] if len(change) else BUNDLE
                yield from found(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from found(held)

    return live.mapInArrow(run, schema)


def _split(large: DataFrame, length: int) -> DataFrame:
    """Occurrences of large grown anchors once for each range of window starts, grouped by what all windows of the range hold.

    `whole` says that an earlier occurrence has the same bytes around; of the others come those that have company.
    """
    _, _, reach = _halves(length)
    low = F.explode(F.sequence(F.lit(0), F.lit(reach), F.lit(RANGE)))
    cut = large.select("id", "at", "a", "left", "right", low.alias("low")).withColumn("high", F.least(F.col("low") + RANGE - 1, F.lit(reach)))
    cut = cut.where((F.length("left") >= F.col("low")) & (F.length("right") >= reach - F.col("high"))).withColumns({
        "a": F.xxhash64("a", "low", F.expr("substring(left, length(left) - low + 1, low)"), F.expr(f"substring(right, 1, {reach} - high)")),
        "left": F.expr("substring(left, greatest(1, length(left) - high + 1), high)"),
        "right": F.expr(f"substring(right, 1, {reach} - low)")})
    cut = cut.where(F.length("left") + F.length("right") >= reach).withColumn("s", F.xxhash64("left", "right", F.length("left")))
    nth = F.row_number().over(Window.partitionBy("a", "s").orderBy("id", "at"))
    size = F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(Window.partitionBy("a")).cast("long")
    met = cut.repartition("a").withColumn("nth", nth).withColumn("size", size).where("nth > 1 or size > 1")
    return met.select("id", "at", "a", "left", "right", "size", (F.col("nth") > 1).alias("whole"))


def repeated_ranges(rows: DataFrame, length: int = LENGTH, variants: int = VARIANTS) -> DataFrame:
    """id, tag, start, end of byte ranges that are made of windows which start earlier elsewhere; `rows` has id, tag, text."""
    reach = length - ANCHOR
    places = _anchors(rows, length)
    alike = Window.partitionBy("a", "s").orderBy("id", "at")
    same = Window.partitionBy("a")
    seen = places.repartition("a").withColumn("nth", F.row_number().over(alike)).withColumn(
        "variants", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(same))
    met = materialize(seen.where("nth > 1 or variants > 1").select("a", "id", "at", (F.col("nth") > 1).alias("whole")), "anchors")

    # The text limits its surroundings; the end is cut when the text is at hand.
    place = F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))
    whole = met.where("whole").select("id", F.shiftright("at", 32).alias("tag"), F.greatest(place - reach, F.lit(0)).alias("start"), (place + length).alias("end"))

    def parts(raw, places, keys):
        for p, a in zip(places, keys):
            yield p, a, raw[max(0, p - reach):p], raw[p + ANCHOR:p + length]

    around = _surroundings(rows, met.where("not whole"), length, "id long, at long, a long, left binary, right binary", parts)
    compared = materialize(_compared(_grown(around, length), length, variants, False), "compared")
    ranges = materialize(_split(compared.where("a is not null"), length), "ranges")
    covered = ranges.where("whole").select("id", (F.col("at") - F.length("left")).alias("at"), (F.length("left") + _halves(length)[1] + F.length("right")).alias("size"))
    rest = ranges.where("not whole").drop("whole").repartition("a").sortWithinPartitions("a", "id", "at")
    finer = materialize(_compared(rest, length, variants, True), "finer")
    marked = compared.where("a is null").select("id", "at", "size").union(covered).union(finer.where("h is null").select("id", "at", "size"))
    single = finer.where("h is not null")
    spot = F.struct("id", "at")
    firsts = single.groupBy("h").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).where("first != last").select("h", "first")
    many = single.join(firsts, "h").where(spot != F.col("first")).select("id", "at", "size")
    start = F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))
    return whole.union(marked.union(many).select("id", F.shiftright("at", 32), start, start + F.col("size")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, variants: int = VARIANTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row."""
    rows = keyed(docs, id_col, text_col).select("doc_id", "id", F.col("th").bitwiseAND(F.lit(0x7FFFFFFF)).alias("tag"), "text")
    ranges = repeated_ranges(rows, length, variants).groupBy("id", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    joined = rows.join(ranges, ["id", "tag"], "left").select("doc_id", "text", "starts", "ends")

    def make():
        def step(batch):
            out = ([], [], [], [])
            for text, starts, ends in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                raw = (text or "").encode()
                kept, removed, runs = cut_out(raw, starts, [min(e, len(raw)) for e in ends]) if starts else (raw, 0, 0)
                for column, value in zip(out, (len(raw), removed, runs, kept)):
                    column.append(value)
            return batch.column(0), *out
        return step

    return map_batches(joined, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
