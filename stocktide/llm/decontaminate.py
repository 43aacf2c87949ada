"""Leaks of a benchmark into documents by spaced seeds over words.

A mask keeps some words of a short window and ignores the others. Windows of the benchmark and of the
documents are hashed under each mask and matched; around a hit the two texts are compared word by word
on the same alignment, and any stretch that is long enough and agrees enough counts, whatever surrounds it.
The masks meet every stretch of 13 words or more of which 4 in 5 agree, and the short masks (for items below
13 words, or for all if shorter overlaps are asked for) every one of five words or more; tested on all patterns.

The benchmark is the stated query set. Its hashes are sent to the tasks in blocks of bounded size, and
every block is held against all documents, so a larger benchmark takes more passes and not more memory.

Cases: null and blank texts and items match nothing; an item with fewer words than a verified overlap
must agree over its whole length, and one below five words is not searched; repeated rows and ids keep
a row each; other columns are ignored; empty tables give an empty result; a text of any length needs
the memory of its word hashes in one task.
"""

from __future__ import annotations

import sys
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, keyed, map_batches, read, slices
from .words import mixed, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MASKS = ("11111", "1101101", "1110011", "110010011")
SHORT_MASKS = ("1111", "11101", "11011", "10111")
COVERED = 13  # words; MASKS alone meet every overlap from here on
BLOCK_BYTES = 8 << 20  # of benchmark text in one pass
_ODD = np.uint64(0x9E3779B97F4A7C15)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the kept words of the window from each word on."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, len(mask), dtype=np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            total = total * _ODD + words[i:i + n]
    return mixed(total)


class Items:
    """Seeds of one block of benchmark items, with the place each comes from."""

    def __init__(self, items: list[tuple[int, str]], least_words: int = COVERED):
        self.ids = [i for i, _ in items]
        self.words, self.begins = word_hashes([t for _, t in items])
        owner = np.repeat(np.arange(len(items)), np.diff(self.begins))
        self.owner = owner
        short = (np.diff(self.begins) < COVERED) | (least_words < COVERED)
        self.tables = []
        for mask in (*MASKS, *SHORT_MASKS):
            hashes = seeds(self.words, mask)
            at = np.nonzero(owner[:len(hashes)] == owner[len(mask) - 1:])[0] if len(hashes) else np.zeros(0, dtype=int)
            if mask in SHORT_MASKS:
                at = at[short[owner[at]]]
                if not len(at):
                    continue
            hashes = hashes[at]
            order = np.argsort(hashes, kind="stable")
            hashes, at = hashes[order], at[order]
            bits = max(16, int(len(hashes)).bit_length() + 4)
            seen = np.zeros(1 << bits, dtype=bool)
            seen[hashes >> np.uint64(64 - bits)] = True
            self.tables.append((mask, hashes, at, seen, np.uint64(64 - bits)))

    def hits(self, words: np.ndarray):
        """(place in the words, place in the items) of equal seeds."""
        for mask, hashes, at, seen, shift in self.tables:
            mine = seeds(words, mask)
            here = np.nonzero(seen[mine >> shift])[0]
            low, high = (np.searchsorted(hashes, mine[here], side) for side in ("left", "right"))
            count = high - low
            here, low, count = here[count > 0], low[count > 0], count[count > 0]
            begin = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if len(count) else low
            yield np.repeat(here, count), at[begin + np.arange(count.sum())]


def best_stretch(same: np.ndarray, identity: float, least: int) -> tuple[int, int, int] | None:
    """(start, end, agreeing words) of the longest stretch of `least` words or more of which a share of `identity` agrees.

    Differing words at its ends are left off as long as `least` words remain.
    """
    share = Fraction(identity).limit_denominator(1000)  # whole numbers: a share of exactly `identity` counts
    score = np.concatenate([[0], np.cumsum(np.where(same, share.denominator - share.numerator, -share.numerator))])
    starts = np.searchsorted(-np.minimum.accumulate(score), -score, side="left")  # the first place no higher than each end
    lengths = np.arange(len(score)) - starts
    end = int(np.argmax(lengths))
    start = int(starts[end])
    if end - start < max(1, least):
        return None
    agreeing = start + np.nonzero(same[start:end])[0]
    if len(agreeing) and agreeing[-1] + 1 - agreeing[0] >= least:
        start, end = int(agreeing[0]), int(agreeing[-1]) + 1
    return start, end, len(agreeing)


def overlaps(texts: list[str], items: Items, least_words: int, identity: float):
    """(text number, item number, agreeing words, length, first word in the text) of verified overlaps, the best of each pair."""
    words, begins = word_hashes(texts)
    diagonals = set()
    for place, other in items.hits(words):
        text = np.searchsorted(begins, place, side="right") - 1
        diagonals.update(zip(text.tolist(), items.owner[other].tolist(), (place - begins[text] - (other - items.begins[items.owner[other]])).tolist()))
    best = {}
    for text, item, shift in diagonals:
        mine = words[begins[text]:begins[text + 1]]
        other = items.words[items.begins[item]:items.begins[item + 1]]
        low, high = max(0, -shift), min(len(other), len(mine) - shift)
        stretch = best_stretch(mine[low + shift:high + shift] == other[low:high], identity, min(least_words, len(other)))
        if stretch:
            start, end, same = stretch
            found = (same, end - start, -(low + shift + start))
            best[text, item] = max(best.get((text, item), found), found)
    for (text, item), (same, length, at) in sorted(best.items()):
        yield text, item, same, length, -at


def leaks(docs: DataFrame, items: DataFrame, least_words: int = 13, identity: float = 0.8, item_id: str = "item_id", item_text: str = "text",
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, th, doc_id, item_id, matched and length (words), first_word; `docs` as from `keyed`. One row for each leaking pair."""
    schema = "id long, th long, doc_id long, item_id long, matched long, length long, first_word long"
    result = None
    for shared in blocks_of(items, item_id, item_text, block_bytes):
        def make(shared=shared):
            known = Items(shared.value, least_words)

            def step(batch):
                keys, ths, ids = (batch.column(c).to_pylist() for c in ("id", "th", "doc_id"))
                texts = [t or "" for t in batch.column("text").to_pylist()]
                out = tuple([] for _ in range(7))
                for low, high in bounded(texts):
                    for text, item, same, length, at in overlaps(texts[low:high], known, least_words, identity):
                        i = low + text
                        for column, value in zip(out, (keys[i], ths[i], ids[i], known.ids[item], same, length, at)):
                            column.append(value)
                return out

            return step

        found = map_batches(docs, make, schema)
        result = found if result is None else result.unionByName(found)
    return result


def blocks_of(items: DataFrame, item_id: str, item_text: str, block_bytes: int):
    """Broadcasts of the items, each of bounded size; at least one."""
    bench = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for block in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # one bounded block
        yield items.sparkSession.sparkContext.broadcast(sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in part))


def drop_leaking(docs: DataFrame, items: DataFrame, least_words: int = 13, identity: float = 0.8, text_col: str = "text", item_id: str = "item_id",
                 item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows, with all their columns, that overlap with no item; narrow, one pass for each block of items."""
    for shared in blocks_of(items, item_id, item_text, block_bytes):
        def run(batches, shared=shared):
            known = Items(shared.value, least_words)
            for batch in batches:
                for part in slices(batch):
                    texts = [t or "" for t in part.column(text_col).to_pylist()]
                    clean = np.ones(len(texts), dtype=bool)
                    for low, high in bounded(texts):
                        clean[[low + text for text, *_ in overlaps(texts[low:high], known, least_words, identity)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(keyed(read(spark, sf_dir), "doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "length", "first_word")
