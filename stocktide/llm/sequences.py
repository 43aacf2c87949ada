"""Token ids in Arrow files of equal-length sequences with masks.

Each task owns a range of document ids, encodes it in order and writes one file: record batches of
fixed-size lists, `input_ids` of 16 or 32 bits and a bit-packed `mask` that is false on the padding
of the last sequence. A file is written under a name of its own attempt and counts only if the index
names it, so a task that is run again leaves no doubt. The index has one row per document: file,
first token in the file, number of tokens. Any sequence is read by its number without a copy.

Cases: a null text is empty and has only the end id; documents without id come last; repeated rows
and ids keep a row each (in the order of their texts); other columns are ignored; an empty table
gives an empty index. A text needs the memory of its own ids in one task.
"""

from __future__ import annotations

import re
import struct
import sys
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktide.session import work_path

from . import bpe
from .common import arrow_schema, identified, per_process, read, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

INDEX = "row long, doc_id long, shard long, file string, first long, n_tokens long"
BATCH = 256  # sequences in a record batch
# Words of printable ASCII and letters that no normal form changes and that have one lower-case letter each.
_LETTERS = "À-ÖØ-öø-ÿŒœ"
_PLAIN = re.compile(f"[!-~{_LETTERS}]+")
# The pre-token pattern of the word-level vocabulary, for such words in lower case (fixed value).
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^\sa-z0-9ß-öø-ÿœ]+")


class WordEncoder:
    """Ids of a word-level BPE file: white space separates, so each word is encoded once and remembered."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(text)
        library.no_truncation()
        library.no_padding()
        self.wide = library.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self._library = library
        self._special = [t.content for t in library.get_added_tokens_decoder().values()]
        model, before, normal = library.model, library.pre_tokenizer, library.normalizer
        code = "I" if self.wide else "H"
        pack = lambda ids: struct.pack(f"<{len(ids)}{code}", *ids)
        symbols = {c: before.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x180) if re.match(f"[{_LETTERS}]", chr(c))}
        token = bpe.Memory(lambda p: pack([t.id for t in model.tokenize(p)]))

        def of_word(word: str) -> bytes:
            if _PLAIN.fullmatch(word):
                found = _PIECES.findall(word.lower())
                return b"".join(map(token.__getitem__, found if word.isascii() else [p.translate(symbols) for p in found]))
            return b"".join(token[p] for p, _ in before.pre_tokenize_str(normal.normalize_str(word)))

        self._known = bpe.Memory(of_word)
        self._pack = pack

    @classmethod
    def shared(cls, text: str) -> WordEncoder:
        return per_process(("word_encoder", hash(text)), lambda: cls(text))

    def ids(self, text: str) -> bytes:
        if bpe._ODD.search(text) or any(s in text for s in self._special):
            return self._pack(self._library.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self._known.__getitem__, text.split()))


def opened(folder: str):
    """The file system of a folder that all executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class SequenceFile:
    """Appends ids and writes full batches of sequences."""

    def __init__(self, sink, length: int, kind: np.dtype):
        self.length, self.kind, self.held, self.count, self.total = length, kind, [], 0, 0
        ids = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("input_ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.count += len(ids)
        self.total += len(ids)
        size = BATCH * self.length
        if self.count >= size:
            flat = np.concatenate(self.held)
            cut = len(flat) - len(flat) % size
            for start in range(0, cut, size):
                self._batch(flat[start:start + size], size)
            self.held, self.count = [flat[cut:]], len(flat) - cut

    def _batch(self, flat: np.ndarray, real: int) -> None:
        pad = -len(flat) % self.length
        flat = np.concatenate([flat, np.zeros(pad, dtype=self.kind)]) if pad else flat
        mask = np.arange(len(flat)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.count:
            flat = np.concatenate(self.held)
            self._batch(flat, len(flat))
        self.out.close()


class SequenceReader:
    """Random access to the sequences of one file, mapped into memory where the file is local."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        system, path = opened(folder)
        path = f"{path}/{name}"
        local = isinstance(system, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else system.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("input_ids").type.list_size

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of the i-th sequence; the ids are a view of the file."""
        batch = self.file.get_batch(i // BATCH)
        at = i % BATCH
        ids, mask = (batch.column(c).slice(at, 1).flatten() for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, count: int) -> np.ndarray:
        """Consecutive tokens of the file, across sequences and batches."""
        size, found = BATCH * self.length, []
        while count > 0:
            flat = self.file.get_batch(start // size).column(0).flatten().to_numpy(zero_copy_only=True)
            part = flat[start % size:start % size + count]
            found.append(part)
            start, count = start + len(part), count - len(part)
        return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, dtype="<u2")

    def close(self) -> None:
        self.source.close()


def write_sequences(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, length: int = 512, shards: int | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files below `folder` and return the index, itself written there as a table."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bpe.read_text(tokenizer or bpe.default_path("word_bpe_49k.json")))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    system, path = opened(folder)
    system.create_dir(path, recursive=True)

    def write(batches):
        from pyspark import TaskContext

        encoder = WordEncoder.shared(shared.value)
        shard, schema, out = TaskContext.get().partitionId(), arrow_schema(INDEX), None
        name, row = f"shard-{shard:06d}-{uuid.uuid4().hex}.arrow", 0
        for batch in batches:
            for part in slices(batch):
                if out is None:
                    system, path = opened(folder)
                    sink = system.open_output_stream(f"{path}/{name}")
                    out = SequenceFile(sink, length, np.dtype("<u4") if end_id >= 1 << 16 or encoder.wide else encoder.kind)
                firsts, counts = [], []
                for text in part.column(1).to_pylist():
                    ids = np.append(np.frombuffer(encoder.ids(text or ""), dtype=encoder.kind), encoder.kind.type(end_id))
                    firsts.append(out.total)
                    counts.append(len(ids))
                    out.append(ids.astype(out.kind, copy=False))
                n = len(counts)
                columns = [range(row, row + n), part.column(0), [shard] * n, [name] * n, firsts, counts]
                row += n
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
        if out is not None:
            out.close()
            sink.close()

    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    ranged = identified(docs, id_col, text_col).repartitionByRange(shards, order[0]).sortWithinPartitions(*order)
    index = ranged.mapInArrow(write, INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def with_starts(index: DataFrame) -> DataFrame:
    """`start`: ids of all documents before this one. Offsets of the files come from one row per file."""
    spark = index.sparkSession
    sums = sorted(index.groupBy("shard").agg(F.sum("n_tokens")).collect())  # one row per file
    offsets, total = [], 0
    for shard, n in sums:
        offsets.append((shard, total))
        total += n
    base = spark.createDataFrame(offsets, "shard long, base long")
    return index.join(F.broadcast(base), "shard").select(*index.columns, (F.col("base") + F.col("first")).alias("start"))


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids of each document, as read from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def check(batches):
        out, reader, name = arrow_schema(schema), None, None
        for batch in batches:
            for part in slices(batch):
                files, firsts, counts = (part.column(c).to_pylist() for c in ("file", "first", "n_tokens"))
                sums = []
                for file, first, count in zip(files, firsts, counts):
                    if file != name:
                        if reader:
                            reader.close()
                        reader, name = SequenceReader(folder, file), file
                    sums.append(zlib.crc32(reader.tokens(first, count).astype("<u4").tobytes()))
                columns = [part.column("doc_id"), part.column("start"), part.column("n_tokens"), sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)
        if reader:
            reader.close()

    return with_starts(index).mapInArrow(check, schema)


def op3_token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "sequences")
    return read_back(write_sequences(read(spark, sf_dir), folder), folder)
