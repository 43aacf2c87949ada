"""Packing against the tokenizers library and against best-fit decreasing, on whole tables and odd rows."""

import bisect
import collections
import itertools
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("stocktide.llm")

from pyspark.sql import functions as F  # noqa: E402

from stocktide.llm import bpe, packing  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (2, ""), (3, "a"), (None, "x y z"), (4, "été là. <|endoftext|> b\n\n c"), (5, "word " * 30), (6, "\x00 \x1c"), (7, "x " * 16)]


def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(bpe.default_path("word_bpe_49k.json"))
    found.no_truncation()
    found.no_padding()
    return found


def wanted(rows, capacity):
    encode = library().encode
    out = collections.Counter()
    for doc, text in rows:
        ids = [*encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start:start + capacity], dtype="<u4").tobytes()
            out[doc, piece, start, len(part) // 4, zlib.crc32(part)] += 1
    return out


def best_fit(lengths, capacity):
    rooms, used = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        left = capacity if at == len(rooms) else rooms.pop(at)
        used += left == capacity
        bisect.insort(rooms, left - n)
    return used


def gapless(found, capacity):
    held = collections.defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [16, 31, 4096])
def test_odd_rows_are_packed_whole(spark, capacity):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"part": F.lit("clash"), "rank": F.lit(0), "length": F.lit(None)})
    found = packing.packed(packing.cut(docs, capacity=capacity), capacity).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted(ODD, capacity)
    assert gapless(found, capacity) <= best_fit([r.length for r in found], capacity)


def test_documents_are_packed_as_tightly_as_best_fit(spark):
    found = packing.op11_pattern_packing(spark, SF).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted(rows, 4096)
    assert gapless(found, 4096) <= best_fit([r.length for r in found], 4096)


def test_sequences_hold_the_ids_of_their_pieces(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    found = packing.sequences(docs, capacity=16).collect()
    pieces = collections.Counter()
    for r in found:
        ids, at = np.frombuffer(bytes(r.input_ids), dtype="<u4"), 0
        assert len(ids) == sum(r.lengths) <= 16
        for n in r.lengths:
            pieces[n, zlib.crc32(ids[at:at + n].tobytes())] += 1
            at += n
    want = collections.Counter()
    for (_, _, _, n, crc), count in wanted(ODD, 16).items():
        want[n, crc] += count
    assert pieces == want


def test_an_empty_table_gives_no_piece(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(packing.cut(empty)).collect() == []
    assert packing.sequences(empty).collect() == []


@pytest.mark.parametrize("seed", range(12))
def test_plans_use_every_length_once_and_waste_little(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 100, 1000, 4096])
    lengths = collections.Counter(min(capacity, int(rng.paretovariate(rng.choice([0.7, 1.5])) * rng.choice([1, 20, 200])) or 1) for _ in range(rng.choice([1, 30, 3000])))
    if seed % 3 == 0:
        lengths[capacity // 2 + 1] += 5000
    used = collections.Counter()
    classes = packing.plan(dict(lengths), capacity)
    for count, held in classes:
        assert count > 0 and sum(n * m for n, m in held) <= capacity
        for n, m in held:
            used[n] += count * m
    assert used == lengths
    assert sum(c for c, _ in classes) <= best_fit(list(lengths.elements()), capacity) * 1.01


def test_the_fit_is_the_least_nonnegative_one():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = rng.random((6, 9)), rng.random(6)
        x = packing.nonnegative_fit(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6).all() and np.abs(slope[x > 0]).max() < 1e-6


def test_patterns_are_all_sums_of_few_bins():
    want = {tuple(sorted(p, reverse=True)) for k in range(1, 4) for p in itertools.product(range(1, 13), repeat=k) if sum(p) == 12}
    assert set(packing.patterns(12, 3)) == want and len(packing.patterns(12, 3)) == len(want)
