"""BPE encoding and decoding with tree concatenation of long texts.

A long text is cut into leaves that are encoded in parallel tasks. Leaves that meet at a pre-token
boundary join as they are. Leaves cut inside an unsplit stretch are joined in a balanced tree: the
last tokens of the left and the first of the right are encoded anew, in a window that grows until
its tokens agree with both sides. They agree when every pair of tokens that meets at a seam, encoded
on its own, gives back that pair; a sequence of which this holds everywhere is the encoding.

Cases: a null text is empty (0 tokens, hashes of the empty string); special strings give their ids
as in the library; repeated rows and ids stay separate rows; other columns are ignored; an empty
table gives an empty result; a text of any length needs the memory of its own ids in one task.
"""

from __future__ import annotations

import hashlib
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import arrow_schema, identified, map_batches, per_process, read

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF = 16_384  # code points of a leaf
KNOWN = 150_000  # pieces that a worker remembers in each of two generations


class Encoder:
    """Ids of a text through its pieces; new pieces are encoded from the merge ranks of the file."""

    def __init__(self, text: str):
        import tiktoken

        self.vocab = bpe.Vocabulary.shared(text)
        plain = {b: i for i, b in enumerate(self.vocab.bytes) if b.decode("utf-8", "replace") not in self.vocab.special}
        made = [pair[1] for pair in self.vocab.ranks.values()]
        if made != sorted(made):
            raise ValueError("ids must rise with the rank of their merge")
        library = tiktoken.Encoding("file", pat_str=bpe.PATTERN, mergeable_ranks=plain, special_tokens={})
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.vocab.special, key=len, reverse=True))) + ")") if self.vocab.special else None
        special = self.vocab.special
        self._known = bpe.Memory(lambda p: np.array([special[p]] if p in special else library.encode_ordinary(p), dtype="<u4").tobytes(), KNOWN)
        self._decimal = [str(i) for i in range(len(self.vocab.bytes))]

    @classmethod
    def shared(cls, text: str) -> Encoder:
        return per_process(("encoder", hash(text)), lambda: cls(text))

    def parts(self, text: str) -> list[str]:
        """The text cut at special strings, which stay as parts of their own."""
        return [p for p in self._special.split(text) if p] if self._special else [text] if text else []

    def pieces(self, text: str) -> list[str]:
        return [x for p in self.parts(text) for x in ([p] if p in self.vocab.special else bpe.pieces(p))]

    def ids_of(self, pieces: list[str]) -> bytes:
        return b"".join(map(self._known.__getitem__, pieces))

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of the whole text."""
        return self.ids_of(self.pieces(text))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocab.bytes.__getitem__, ids)).decode("utf-8", errors="replace")

    def digest(self, ids: bytes) -> tuple[int, str, str]:
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        joined = ",".join(map(self._decimal.__getitem__, numbers))
        return len(numbers), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(self.decode(numbers).encode()).hexdigest()


def leaves(text: str, encoder: Encoder, leaf: int = LEAF):
    """(glued, unsplit, pieces): pieces that stand between safe cuts, or a part of an unsplit stretch.

    `glued` says that the leaf continues the stretch of the one before it.
    """
    held: list[str] = []
    size = 0
    for piece in encoder.pieces(text):
        tokens = [piece] if len(piece) <= leaf or piece in encoder.vocab.special else bpe.pretokens(piece)
        for token in tokens:
            if held and size + len(token) > leaf:
                yield False, False, held
                held, size = [], 0
            if len(token) <= leaf or token in encoder.vocab.special:
                held.append(token)
                size += len(token)
                continue
            for start in range(0, len(token), leaf):
                yield start > 0, True, [token[start:start + leaf]]
    if held:
        yield False, False, held


def join_tokens(left: list[int], right: list[int], vocab, window: int = 4) -> list[int]:
    """The encoding of two adjoining parts of one unsplit stretch."""
    def encoded(ids):
        return bpe.merged_ids(b"".join(map(vocab.bytes.__getitem__, ids)), vocab)

    def agree(a, b):
        return encoded([a, b]) == [a, b]

    while True:
        keep, skip = max(0, len(left) - window), min(len(right), window)
        middle = encoded(left[keep:] + right[:skip])
        if (keep == 0 or agree(left[keep - 1], middle[0])) and (skip == len(right) or agree(middle[-1], right[skip])):
            return left[:keep] + middle + right[skip:]
        window *= 2


def joined(parts: list[list[int]], vocab) -> list[int]:
    """Neighbours joined pair by pair, level by level."""
    while len(parts) > 1:
        parts = [join_tokens(*parts[i:i + 2], vocab) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def encode(docs: DataFrame, tokenizer: str | None = None, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian 32-bit) of every whole text."""
    return _encoded(docs, tokenizer, leaf, id_col, text_col, "doc_id long, ids binary", lambda encoder, ids: (ids,))


def encode_digest(docs: DataFrame, tokenizer: str | None = None, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, hash of the ids and hash of the text decoded from them."""
    return _encoded(docs, tokenizer, leaf, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                    lambda encoder, ids: encoder.digest(ids))


def _encoded(docs, tokenizer, leaf, id_col, text_col, schema, result):
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bpe.read_text(tokenizer or bpe.default_path("byte_bpe_50k.json")))
    rows = identified(docs, id_col, text_col)
    is_long = F.coalesce(F.length("text"), F.lit(0)) > leaf

    def whole():
        encoder = Encoder.shared(shared.value)

        def step(batch):
            found = [result(encoder, encoder.ids(t or "")) for t in batch.column(1).to_pylist()]
            return batch.column(0), *zip(*found)

        return step

    def cut():
        encoder = Encoder.shared(shared.value)

        def step(batch):
            out = ([], [], [], [], [], [])
            for row, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for seq, (glued, unsplit, pieces) in enumerate(leaves(text, encoder, leaf)):
                    for column, value in zip(out, (row, doc, seq, glued, unsplit, pieces)):
                        column.append(value)
            return out

        return step

    def encode_leaf():
        encoder = Encoder.shared(shared.value)

        def step(batch):
            unsplit, pieces = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            ids = [np.array(bpe.merged_ids(p[0].encode(), encoder.vocab), dtype="<u4").tobytes() if u else encoder.ids_of(p)
                   for u, p in zip(unsplit, pieces)]
            return *(batch.column(i) for i in range(4)), ids

        return step

    def assemble(table: pa.Table) -> pa.Table:
        encoder = Encoder.shared(shared.value)
        parts = sorted(zip(*(table.column(c).to_pylist() for c in ("seq", "glued", "ids"))))
        runs: list[list[bytes]] = []
        for _, glued, ids in parts:
            if glued:
                runs[-1].append(ids)
            else:
                runs.append([ids])
        ids = b"".join(
            r[0] if len(r) == 1 else np.array(joined([np.frombuffer(x, dtype="<u4").tolist() for x in r], encoder.vocab), dtype="<u4").tobytes() for r in runs)
        out = arrow_schema(schema)
        values = [table.column("doc_id")[0].as_py(), *result(encoder, ids)]
        return pa.Table.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, out)], schema=out)

    short = map_batches(rows.where(~is_long), whole, schema)
    row = F.monotonically_increasing_id().alias("row")  # rows may repeat an id
    cuts = map_batches(rows.where(is_long).select(row, "doc_id", "text"), cut, "row long, doc_id long, seq long, glued boolean, unsplit boolean, pieces array<string>")
    encoded = map_batches(cuts.repartition(F.col("row"), F.col("seq")), encode_leaf, "row long, doc_id long, seq long, glued boolean, ids binary")
    return short.unionByName(encoded.groupBy("row").applyInArrow(assemble, schema))


def op1_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(read(spark, sf_dir))
