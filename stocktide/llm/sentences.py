"""Exact repeats of sliding sentence spans.

Words stand between white space; each character of a script without spaces is one. A text is cut into pieces: at a full stop, question or exclamation mark before white space, at a line end,
and inside every sentence after the word with the smallest hash of each ten in a row. A cut hangs on the
ten words around it alone, so a passage gets the same pieces wherever it stands, but for up to nine words
at an end that is glued to foreign words; ten words without a cut do not occur, so a passage of 50 words
or more always shares a span. A span takes two pieces or more, until it has enough words, from each piece
on and back from each piece. All occurrences of a hash meet sorted; every one but the first (smallest id,
then text hash, then position) is removed with the pieces it covers.

Cases: a null or blank text has no span and comes back empty; a text with fewer words than a span
stays as it is; repeats inside a document count; rows that repeat id and text are one document;
a missing id counts as the largest; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, cut_out, keyed, map_batches, per_process, read, slices
from .words import mixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 10  # words
_END = re.compile(r"[.!?…][^\w\s]*\s+|[。！？][^\w\s]*\s*|\s*\n\s*")
_WORD = re.compile(r"\S+\s*")
# Scripts without spaces (Thai to Khmer, kana, ideographs): each character is a word.
_WIDE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_HAS_WIDE = re.compile(f"[{_WIDE}]")
_WIDE_WORD = re.compile(rf"[{_WIDE}]\s*|[^\s{_WIDE}]+\s*")
_BASE = 0x9E3779B97F4A7C15  # odd, for the powers in span hashes


def pieces(text: str, window: int = WINDOW) -> tuple[list[str], list[int], list[int]]:
    """Lower-case words, the number of words before each piece (and all of them), the place where each piece begins (and the end)."""
    if text.isascii() or not _HAS_WIDE.search(text):
        words, each = text.lower().split(), _WORD
    else:
        words, each = [w.rstrip().lower() for w in _WIDE_WORD.findall(text)], _WIDE_WORD
    if not words:
        return [], [0], [0]
    ends = np.fromiter((m.end() for m in each.finditer(text)), dtype=np.int64, count=len(words))
    stops = np.fromiter((m.end() for m in _END.finditer(text)), dtype=np.int64)
    cut = np.zeros(len(words), dtype=bool)  # after the word
    last = np.searchsorted(ends, stops)
    cut[last[last < len(words)]] = True
    cut[-1] = True
    if len(words) >= window:
        sentence = np.cumsum(cut) - cut
        hashes = np.fromiter((zlib.crc32(w.encode(errors="replace")) for w in words), dtype=np.uint32, count=len(words))
        inside = np.nonzero(sentence[:len(words) - window + 1] == sentence[window - 1:])[0]
        views = np.lib.stride_tricks.sliding_window_view(hashes, window)
        for k in range(0, len(inside), 1 << 16):
            at = inside[k:k + (1 << 16)]
            cut[at + window - 1 - np.argmin(views[at][:, ::-1], axis=1)] = True
    after = np.nonzero(cut)[0] + 1
    return words, [0, *after.tolist()], [0, *ends[after[:-1] - 1].tolist(), len(text)]


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base & (1 << 64) - 1, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_arrays(text: str, least_sentences: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of the shortest spans with enough words that begin at a piece, and of those that end where none of these does."""
    import xxhash

    words, before, places = pieces(text)
    n = len(before) - 1
    if n < least_sentences or len(words) < least_words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    power, inverse = per_process("span_powers", lambda: [None, None])
    if power is None or len(power) <= n:
        power, inverse = _powers(_BASE, 2 * n + 64), _powers(pow(_BASE, -1, 1 << 64), 2 * n + 64)
        per_process("span_powers", list)[:] = power, inverse
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(" ".join(words[i:j])) for i, j in zip(before, before[1:])), dtype=np.uint64, count=n)
    # Sums of the piece hashes times powers: a span's hash is a difference, moved to the same place for equal spans.
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * power[:n], dtype=np.uint64)])
    count, place = np.array(before), np.array(places)
    begin = np.arange(n)
    end = np.maximum(begin + least_sentences, np.searchsorted(count, count[:-1] + least_words))
    begin, end = begin[end <= n], end[end <= n]
    # The shortest span that ends at a piece, for the rest of a repeat behind the last one that begins in it.
    last = np.setdiff1d(np.arange(1, n + 1), end)
    first = np.minimum(last - least_sentences, np.searchsorted(count, count[last] - least_words, side="right") - 1)
    begin, end = np.concatenate([begin, first[first >= 0]]), np.concatenate([end, last[first >= 0]])
    return mixed((sums[end] - sums[begin]) * inverse[begin]), place[begin], place[end]


def spans(text: str, least_sentences: int, least_words: int):
    """(hash, start, end) of the spans of a text."""
    return zip(*(a.tolist() for a in span_arrays(text, least_sentences, least_words)))


class Occurrences:
    """Spans of a bounded number of texts; those that follow another one with their hash are known to go."""

    def __init__(self):
        self.held, self.count = [], 0

    def add(self, h, id_, th, start, end) -> None:
        n = len(h)
        self.held.append((h.view(np.int64), np.full(n, id_), np.full(n, th), start << 32 | end))
        self.count += n

    def drain(self):
        """Columns of the first occurrence of each hash and, with the place's bits turned over, of the merged ranges of the others."""
        h, id_, th, place = (np.concatenate(c) for c in zip(*self.held))
        self.held, self.count = [], 0
        order = np.lexsort((place, th, id_, h))
        h, id_, th, place = h[order], id_[order], th[order], place[order]
        head = np.concatenate([[True], h[1:] != h[:-1]])
        of = np.nonzero(head)[0][np.cumsum(head) - 1]
        again = np.nonzero((id_ != id_[of]) | (th != th[of]) | (place != place[of]))[0]
        ranges = _merged(id_[again], th[again], place[again])
        zero = np.zeros(len(ranges[0]), dtype=np.int64)
        return [np.concatenate(x) for x in zip((h[head], id_[head], th[head], place[head]), (zero, ranges[0], ranges[1], ~ranges[2]))]


def _merged(id_, th, place):
    """The ranges of each text with overlapping and adjoining ones made one."""
    if not len(id_):
        return id_, th, place
    order = np.lexsort((place, th, id_))
    id_, th, start, end = id_[order], th[order], place[order] >> 32, place[order] & 0xFFFFFFFF
    text = np.cumsum(np.concatenate([[0], (id_[1:] != id_[:-1]) | (th[1:] != th[:-1])]))
    reach = np.maximum.accumulate((text << 32) + end)  # a text's ranges reach no further than their own text
    head = np.concatenate([[True], (text[1:] << 32) + start[1:] > reach[:-1]])
    at = np.nonzero(head)[0]
    stop = reach[np.concatenate([at[1:] - 1, [len(head) - 1]])] - (text[at] << 32)
    return id_[at], th[at], start[at] << 32 | stop


BUFFER = 1 << 19  # spans that a task compares before it sends them on


def repeated_spans(docs: DataFrame, least_sentences: int = 2, least_words: int = 12) -> DataFrame:
    """id, th and ranges (start << 32 | end) that hold every span that is not the first of its kind; `docs` as from `keyed`.

    One shuffle by hash. A task sends a hash once for each buffer, so a very common span meets in one
    partition as one row for each buffer and not for each document; what is known to go travels spread out.
    """
    schema = "h long, id long, th long, place long"

    def find(batches):
        out, found = arrow_schema(schema), Occurrences()
        for batch in batches:
            for part in slices(batch):
                for key, th, text in zip(*(part.column(c).to_pylist() for c in ("id", "th", "text"))):
                    h, start, end = span_arrays(text or "", least_sentences, least_words)
                    if len(h):
                        found.add(h, key, th, start, end)
                    if found.count >= BUFFER:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, found.drain())), schema=out)
        if found.count:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, found.drain())), schema=out)

    ranges = "id long, th long, place long"

    def later(batches):
        out, last = arrow_schema(ranges), None  # the first occurrence of the hash before this batch
        for batch in batches:
            h, id_, th, place = (batch.column(c).to_numpy() for c in ("h", "id", "th", "place"))
            known = place < 0
            goes = [(id_[known], th[known], ~place[known])]
            h, id_, th, place = (x[~known] for x in (h, id_, th, place))
            if len(h):
                head = np.concatenate([[last is None or h[0] != last[0]], h[1:] != h[:-1]])
                at = np.cumsum(head) - 1
                firsts = [np.concatenate([[0 if last is None else v], x[head]]) for x, v in zip((id_, th, place), last[1:] if last else (0, 0, 0))]
                a, b, c = (x[at + 1] for x in firsts)
                later_ = (id_ != a) | (th != b) | (place != c)
                goes.append((id_[later_], th[later_], place[later_]))
                last = h[-1], a[-1], b[-1], c[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(*map(np.concatenate, zip(*goes)))], schema=out)

    found = docs.select("id", "th", "text").mapInArrow(find, schema)
    by = F.when(F.col("place") < 0, F.xxhash64("id", "place")).otherwise(F.col("h"))
    return found.repartition(by).sortWithinPartitions("h", "id", "th", "place").mapInArrow(later, ranges)


def _ranged(docs: DataFrame, rows: DataFrame, least_sentences: int, least_words: int) -> DataFrame:
    """`rows` (id, th and more) with the list of ranges that go from their text, or null."""
    places = repeated_spans(docs, least_sentences, least_words).groupBy("id", "th").agg(F.collect_list("place").alias("places"))
    return rows.join(places, ["id", "th"], "left")


def _cut(text: str | None, places) -> tuple[str, int, int]:
    return cut_out(text, [p >> 32 for p in places], [p & 0xFFFFFFFF for p in places]) if places else (text or "", 0, 0)


def remove_repeats(docs: DataFrame, least_sentences: int = 2, least_words: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, kept text, n_removed (code points) and n_spans (maximal removed runs) of every row."""
    rows = keyed(docs, id_col, text_col)
    joined = _ranged(rows, rows, least_sentences, least_words).select("doc_id", "th", "text", "places")

    def make():
        def step(batch):
            doc, th, texts, places = (batch.column(i) for i in range(4))
            return doc, th, *zip(*map(_cut, texts.to_pylist(), places.to_pylist()))
        return step

    return map_batches(joined, make, "doc_id long, th long, text string, n_removed long, n_spans long")


def drop_repeats(docs: DataFrame, least_sentences: int = 2, least_words: int = 12, id_col: str = "doc_id", text_col: str = "text",
                 length_col: str = "n_chars") -> DataFrame:
    """All columns of the rows with repeats cut from their text and its length corrected; a text that is nothing but repeats goes."""
    keys = keyed(docs, id_col, text_col)
    # The columns of the user travel in one of their own, so none of their names can clash.
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"),
                       F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = _ranged(keys, rows, least_sentences, least_words).select("row", "places")
    text_at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                columns, places = part.column(0).flatten(), part.column(1).to_pylist()
                cut = [_cut(t, p)[0] if p else t for t, p in zip(columns[text_at].to_pylist(), places)]
                names = [part.schema.field(0).type.field(i).name for i in range(len(columns))]
                columns[text_at] = pa.array(cut, type=pa.string())
                if length_at is not None:
                    old = columns[length_at]
                    columns[length_at] = pa.array([len(t) if p else n for t, p, n in zip(cut, places, old.to_pylist())], type=old.type)
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array([not p or bool(t.strip()) for t, p in zip(cut, places)], type=pa.bool_()))

    return joined.mapInArrow(run, docs.schema)


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(read(spark, sf_dir))
    return kept.select("doc_id", F.length("text").cast("long").alias("n_kept"), "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))
