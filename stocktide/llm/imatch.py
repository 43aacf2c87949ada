"""I-Match fingerprints: hashes of the in-band terms of a text under many randomised lexicon subsets.

Document frequencies of all terms are counted in Spark. The lexicon holds terms within a band of inverse
document frequency; its upper end is a share of the documents, so the lexicon has at most (mean distinct
terms of a document) / (that share) entries at any corpus size, and is sent to the tasks after a check of
that bound. Each subset keeps a random part of the lexicon; the sorted distinct terms that a text has in
it are hashed to 16 bits. Subsets come in levels of falling size, and two fingerprints are compared on
the sparsest level where most subsets are in use.

Cases: a null or wordless text is empty and has the empty fingerprint; a text without a term in the band
uses all its terms; equal texts have equal fingerprints; repeated rows keep a row each; a missing id
counts as the largest; other columns are ignored; an empty table gives an empty result. A text needs the
memory of its own word hashes in one task.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, bounded, identified, keyed, map_batches, read, slices
from .words import mixed, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEVELS = (8, 32, 128, 512)  # one term in so many
SUBSETS = 16  # of each level
LEAST_SHARE, MOST_SHARE = 2e-4, 0.2  # of the documents that hold a term of the band
LEXICON_LIMIT = 8_000_000


def distinct_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the distinct terms of each text, sorted."""
    words, begins = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(begins))
    order = np.lexsort((words, owner))
    owner, words = owner[order], words[order]
    new = np.ones(len(words), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (words[1:] != words[:-1])
    return owner[new], words[new]


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term (hash), n (documents that hold it), over all documents."""
    schema = "term long, n long"

    def count(batches):
        for batch in batches:
            for part in slices(batch, 5000):
                texts = [t or "" for t in part.column(0).to_pylist()]
                for low, high in bounded(texts, 8 << 20):
                    terms, n = np.unique(distinct_terms(texts[low:high])[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], schema=arrow_schema(schema))

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, schema).groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text_col: str = "text", least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> np.ndarray:
    """Sorted hashes of the terms within the band."""
    total = docs.count()
    low, high = max(2, math.ceil(least_share * total)), max(2, math.floor(most_share * total))
    band = document_frequencies(docs, text_col).where(F.col("n").between(low, high)).select("term")
    found = band.limit(LEXICON_LIMIT + 1).toPandas()["term"].to_numpy(dtype=np.int64)
    if len(found) > LEXICON_LIMIT:
        raise ValueError(f"more than {LEXICON_LIMIT} terms lie within the band; raise least_share")
    return np.sort(found.view(np.uint64))


class Fingerprinter:
    def __init__(self, terms: np.ndarray):
        self.terms = terms
        count = len(LEVELS) * SUBSETS
        self.salts = mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.least = np.repeat([(1 << 64) // n for n in LEVELS], SUBSETS).astype(np.uint64)

    def signatures(self, texts: list[str]) -> np.ndarray:
        """A row of 16-bit signatures for each text; 0 stands for no term."""
        out = np.zeros((len(texts), len(self.salts)), dtype=np.uint16)
        for low, high in bounded(texts):
            owner, terms = distinct_terms(texts[low:high])
            if not len(terms):
                continue
            if len(self.terms):
                at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
                kept = self.terms[at] == terms
                any_kept = np.zeros(high - low, dtype=bool)
                any_kept[owner[kept]] = True
                kept |= ~any_kept[owner]
                owner, terms = owner[kept], terms[kept]
            starts = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[0]
            for i, (salt, least) in enumerate(zip(self.salts, self.least)):
                h = mixed(terms ^ salt)
                inside = h < least
                total = np.add.reduceat(np.where(inside, mixed(h + salt), np.uint64(0)), starts)
                used = np.add.reduceat(inside.astype(np.int64), starts) > 0
                out[low + owner[starts], i] = np.where(used, total % np.uint64(65535) + np.uint64(1), 0)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal signatures, row by row, among the subsets in use on the sparsest level that most texts use."""
    shape = (len(a), len(LEVELS), SUBSETS)
    used, same = ((a != 0) | (b != 0)).reshape(shape), ((a == b) & (a != 0)).reshape(shape)
    n = used.sum(axis=2)
    level = np.where(n >= SUBSETS // 2, np.arange(len(LEVELS)), 0).max(axis=1)
    rows = np.arange(len(a))
    share = same[rows, level].sum(axis=1) / np.maximum(1, n[rows, level])
    return np.where((a == b).all(axis=1), 1.0, share)


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """Rows in descending order of id, cut into `parts` ranges; each range ends with a guest, the row that follows it.

    The row after the last is the first. One shuffle; the driver sees one bound and one row for each range.
    An id that many rows share (no id at all, say) fills several bounds; its rows are cut by their text hash `th`
    into as many ranges.
    """
    bounds = docs.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [1.0], 10 * parts).alias("b")).first()["b"] or []
    spark = docs.sparkSession
    at = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("id"))) if bounds else F.lit(0)
    for b, n in Counter(bounds).items():
        if n > 1:  # the ranges from the first of equal bounds to the last hold this id alone
            share = F.col("th").cast("double") / 2.0**64 + 0.5
            at = F.when(F.col("id") == b, at + F.least(F.floor(share * n), F.lit(n - 1)).cast("int")).otherwise(at)
    ranged = docs.withColumn("range", at)
    tops = sorted((r["range"], r["top"]["id"], r["top"]["th"]) for r in ranged.groupBy("range").agg(F.max(F.struct("id", "th")).alias("top")).collect())
    if not tops:
        return ranged.withColumn("guest", F.lit(False))
    guests = [(tops[i - 1][1], tops[i - 1][2], tops[i][0]) for i in range(len(tops))]
    table = spark.createDataFrame(guests, "id long, th long, goes int")  # one row for each range
    placed = ranged.join(F.broadcast(table), ["id", "th"], "left")
    own = F.array(F.struct(F.col("range").cast("int").alias("range"), F.lit(False).alias("guest")))
    also = F.array(F.struct(F.col("goes").alias("range"), F.lit(True).alias("guest")))
    both = placed.select("doc_id", "id", "th", "text", F.explode(F.when(F.col("goes").isNull(), own).otherwise(F.concat(own, also))).alias("at"))
    both = both.select("doc_id", "id", "th", "text", "at.range", "at.guest")
    return both.repartition(parts, "range").sortWithinPartitions("range", "guest", F.desc("id"), F.desc("th"))


def compare_edits(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(terms)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        out, prints = arrow_schema(schema), Fingerprinter(shared.value)
        held = None  # the last row seen, which waits for the one after it
        for batch in batches:
            for part in slices(batch, 500):
                rows = list(zip(part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()],
                                part.column(2).to_pylist(), part.column(3).to_pylist()))
                rows = ([held] if held else []) + rows
                held = rows[-1]
                pairs = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
                if not pairs:
                    continue
                texts = [r[1] for r in rows]
                edited = [texts[i][:len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][:len(texts[i]) // 2] for i in pairs]
                own, new = prints.signatures(texts), prints.signatures(edited)
                mine, after = own[pairs], own[[i + 1 for i in pairs]]
                columns = [[rows[i][0] for i in pairs], [len(texts[i]) for i in pairs], [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                           [x.astype(">u2").tobytes().hex() for x in mine], [x.astype(">u2").tobytes().hex() for x in new],
                           likeness(mine, new), likeness(mine, after)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)

    ordered = in_order(keyed(docs, id_col, text_col), parts)
    return ordered.select("doc_id", "text", "range", "guest").mapInArrow(run, schema)


def fingerprints(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every text, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def make():
        prints = Fingerprinter(shared.value)

        def step(batch):
            found = prints.signatures([t or "" for t in batch.column(1).to_pylist()])
            return batch.column(0), [x.astype(">u2").tobytes().hex() for x in found]

        return step

    return map_batches(identified(docs, id_col, text_col), make, "doc_id long, fingerprint string")


def op6_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    return compare_edits(docs, lexicon(docs))
