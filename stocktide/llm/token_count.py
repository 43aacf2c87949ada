"""Token counts by heap-and-linked-list merging; identifiers are never produced.

Cases: a null text counts as empty (0 bytes, 0 tokens); special strings inside a text count as one
token each, as in the library; a very long unsplit stretch costs n log n; repeated rows and ids are
counted row by row; other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .common import identified, map_batches, per_process, read

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _counter(text: str):
    vocab = bpe.Vocabulary.shared(text)
    special = re.compile("|".join(map(re.escape, sorted(vocab.special, key=len, reverse=True)))) if vocab.special else None

    def of_pretoken(token: str) -> int:
        """Initial symbols minus merges."""
        raw = token.encode()
        return len(raw) - bpe.merge(raw, vocab)[0]

    pretoken = bpe.Memory(of_pretoken)
    known = bpe.Memory(lambda piece: sum(map(pretoken.__getitem__, bpe.pretokens(piece))))

    def count(document: str) -> int:
        marks = len(special.findall(document)) if special else 0
        parts = special.split(document) if marks else [document]
        return marks + sum(sum(map(known.__getitem__, bpe.pieces(p))) for p in parts if p)

    return count


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text; narrow, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe.read_text(tokenizer or bpe.default_path("byte_bpe_50k.json")))

    def make():
        text = shared.value
        count = per_process(("token_count", hash(text)), lambda: _counter(text))

        def step(batch):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [count(t) for t in texts]
            return batch.column(0), [len(t.encode()) for t in texts], counts, [c > limit for c in counts]

        return step

    return map_batches(identified(docs, id_col, text_col), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir))
