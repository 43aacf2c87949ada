"""Language mixtures of documents by expectation-maximisation over n-gram likelihoods.

Training counts byte trigrams of lower-case letters by language. A document is a mixture of the learned
languages and a uniform background; its proportions are estimated by expectation-maximisation. Sets of
its leading languages grow one by one while the likelihood, less half a logarithm of the number of
n-grams for each language, rises.

Cases: a null text, and one without a letter, is `und` with score 0; rows without language or text
teach nothing; repeated texts of a language teach once; other columns are ignored; an empty table gives an empty
result; if nothing can be learned, all is `und`; a long text is counted in pieces.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, identified, map_batches, per_process, read, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 1 << 16
TRAIN_ROWS = 5000  # labelled rows of each language, in expectation
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _letters() -> np.ndarray:
    """Lower-case ASCII letters and bytes beyond ASCII stay; all else is a space."""
    kept = np.full(256, 32, dtype=np.uint32)
    kept[128:] = np.arange(128, 256)
    for c in b"abcdefghijklmnopqrstuvwxyz":
        kept[c] = c
    return kept


def trigrams(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the trigrams of lower-case text and which of them hold a letter and no two spaces."""
    data = per_process("letters", _letters)[np.frombuffer(raw, dtype=np.uint8)]
    a, b, c = data[:-2], data[1:-1], data[2:]
    keep = ~((b == 32) & ((a == 32) | (c == 32)))
    code = ((a << 16 | b << 8 | c) * np.uint32(2654435761)) >> np.uint32(16)
    return code, keep


def counted(texts: list[str], piece: int = 1 << 20):
    """(text number, bins, counts) for groups of texts; a piece of text is counted at a time."""
    held, size, first = [], 0, 0
    for i, text in enumerate([*texts, None]):
        raw = None if text is None else b"  " + text.lower().encode() + b"  "
        if held and (raw is None or size + len(raw) > piece):
            yield from _counted_group(held, first)
            held, size, first = [], 0, i
        if raw is None:
            return
        if len(raw) > piece:
            total = np.zeros(BINS, dtype=np.int64)
            for at in range(0, len(raw) - 2, piece):
                code, keep = trigrams(raw[at:at + piece + 2])
                total += np.bincount(code[keep], minlength=BINS)
            bins = np.nonzero(total)[0]
            yield np.full(len(bins), i), bins, total[bins]
            first = i + 1
            continue
        held.append(raw)
        size += len(raw)


def _counted_group(raws: list[bytes], first: int):
    code, keep = trigrams(b"".join(raws))
    owner = np.repeat(np.arange(len(raws), dtype=np.uint64), [len(r) for r in raws])[:len(code)]
    key = np.sort(owner[keep] << np.uint64(16) | code[keep])
    at = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, dtype=int)
    unique = key[at]
    yield (unique >> np.uint64(16)).astype(np.int64) + first, (unique & np.uint64(BINS - 1)).astype(np.int64), np.diff(np.append(at, len(key)))


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", rows: int = TRAIN_ROWS, smoothing: float = 0.1, seed: int = 11):
    """(languages, bin probabilities with the background last) from rows with a language.

    Distinct texts are taken by a hash until each language has `rows` of them in expectation, so the fit
    is bounded however often a text repeats; counts are added in Spark and the result has at most
    languages x bins rows.
    """
    known = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    marks = known.select("lang", F.xxhash64("text").alias("mark")).distinct()
    sizes = {r["lang"]: r["n"] for r in marks.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BINS, 0))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, rows / sizes[lang]))])
    part = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_000)) / 1e6
    chosen = known.where(part < F.element_at(share, F.col("lang"))).distinct()
    schema = "lang string, bin int, n long"

    def count(batches):
        totals = {}
        for batch in batches:
            for piece in slices(batch):
                names, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                for owner, bins, n in counted(texts):
                    for i in np.unique(owner):
                        at = owner == i
                        table = totals.setdefault(names[i], np.zeros(BINS, dtype=np.int64))
                        table[bins[at]] += n[at]
        for name, table in totals.items():
            bins = np.nonzero(table)[0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(bins)), pa.array(bins.astype(np.int32)), pa.array(table[bins])], schema=arrow_schema(schema))

    found = chosen.mapInArrow(count, schema).groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((BINS, len(langs)))
    table[found["bin"].to_numpy(), found["lang"].map({name: i for i, name in enumerate(langs)}).to_numpy()] = found["n"].to_numpy()
    table += smoothing
    return langs, np.column_stack([table / table.sum(axis=0), np.full(BINS, 1 / BINS)])


class Mixtures:
    """Proportions of the texts of one group: rows of n-grams with the likelihood of each component."""

    def __init__(self, owner: np.ndarray, like: np.ndarray, counts: np.ndarray):
        self.starts = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[0]
        self.texts = owner[self.starts]
        self.sizes = np.diff(np.append(self.starts, len(owner)))
        self.like, self.counts = like, counts.astype(np.float64)
        self.totals = np.add.reduceat(self.counts, self.starts)

    def chosen(self, which: np.ndarray) -> Mixtures:
        rows = np.repeat(which, self.sizes)
        return Mixtures(np.repeat(self.texts[which], self.sizes[which]), self.like[rows], self.counts[rows])

    def expect(self, share: np.ndarray):
        """Joint likelihoods and their sums."""
        joint = self.like * np.repeat(share, self.sizes, axis=0)
        return joint, joint.sum(axis=1)

    def improve(self, share: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            joint, total = self.expect(share)
            share = np.add.reduceat(joint * (self.counts / total)[:, None], self.starts, axis=0) / self.totals[:, None]
        return share

    def log_likelihood(self, share: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.counts * np.log(self.expect(share)[1]), self.starts)


def infer(mixtures: Mixtures, rounds: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares over all components, shares within the chosen set, and the set's size, for each text."""
    n, width = len(mixtures.texts), mixtures.like.shape[1]
    langs = width - 1
    full = mixtures.improve(np.full((n, width), 1 / width), rounds)
    order = np.argsort(-full[:, :langs], axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    final, size = np.zeros((n, langs)), np.zeros(n, dtype=np.int64)
    best, open_ = np.full(n, -np.inf), np.ones(n, dtype=bool)
    for k in range(1, langs + 1):
        part = mixtures.chosen(open_)
        at = np.nonzero(open_)[0]
        allowed = np.column_stack([rank[at] < k, np.ones(len(at), dtype=bool)])
        share = np.maximum(full[at], 1e-3) * allowed
        share = part.improve(share / share.sum(axis=1, keepdims=True), 4)
        value = part.log_likelihood(share) - 0.5 * k * np.log(part.totals)
        better = value > best[at]
        won = at[better]
        best[won], size[won] = value[better], k
        final[won] = share[better, :langs]
        open_[at[~better]] = False
        if not open_.any():
            break
    return full, final, size


def judge(texts: list[str | None], langs: list[str], table: np.ndarray):
    """Language, its share, the chosen set and the share of the background for each text."""
    texts = [t or "" for t in texts]
    n = len(texts)
    pred, score, sets, none = [UNDETERMINED] * n, [0.0] * n, [""] * n, [1.0] * n
    able = [i for i, t in enumerate(texts) if langs and _LETTER.search(t)]
    for owner, bins, counts in counted([texts[i] for i in able]):
        if not len(owner):
            continue
        m = Mixtures(owner, table[bins], counts)
        full, final, size = infer(m)
        order = np.argsort(-final, axis=1, kind="stable")
        for j, text in enumerate(m.texts):
            i, top = able[text], order[j, 0]
            pred[i], score[i] = langs[top], float(min(1.0, full[j, top]))
            sets[i] = " ".join(langs[x] for x in order[j, :size[j]])
            none[i] = float(min(1.0, full[j, -1]))
    return pred, score, sets, none


def keep_determined(docs: DataFrame, model, text_col: str = "text", most_background: float = 0.5) -> DataFrame:
    """Rows, with all their columns, in which a learned language leads and the background does not prevail."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        langs, table = shared.value
        for batch in batches:
            for part in slices(batch):
                pred, _, _, none = judge(part.column(text_col).to_pylist(), langs, table)
                yield part.filter(pa.array([p != UNDETERMINED and b <= most_background for p, b in zip(pred, none)], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, lang_pred, score (share of that language), langs (the chosen set) and background (share of none)."""
    langs, table = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, table))
    rows = identified(docs, id_col, text_col).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")

    def make():
        langs, table = shared.value

        def step(batch):
            return batch.column(0), batch.column(1), *judge(batch.column(2).to_pylist(), langs, table)

        return step

    return map_batches(rows, make, "doc_id long, th long, lang_pred string, score double, langs string, background double")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame):
    """The model from the rows that are not held out."""
    return train(docs.where(~F.coalesce(held_out(), F.lit(False))))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    found = predict(docs, fit(docs))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "langs", "background")
