"""Shared pieces of the text operators."""

from __future__ import annotations

import sys
import types

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names; other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def per_process(key, make):
    """What `make` returns, built once in each Python worker.

    Task code is pickled by value, so a module global would be rebuilt by every task.
    """
    name = "_stocktide_llm_state"
    state = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in state:
        state[key] = make()
    return state[key]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a join key: `id` (a missing id counts as the largest) and `th`, a hash of the text.

    Rows that repeat both id and text are one document; each of them gets its result.
    """
    rows = identified(docs, id_col, text_col)
    return rows.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "doc_id", "text")


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows, with all their columns, whose key (see `keyed`) is not in `gone` (id, th).

    The columns of the user travel in one of their own, so none of their names can clash.
    """
    whole = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("th"),
                        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return whole.join(gone, ["id", "th"], "left_anti").select("row.*")


def slices(batch: pa.RecordBatch, rows: int = 1000):
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def bounded(raws: list[bytes], limit: int = 2 << 20):
    """Ranges of consecutive texts of at most `limit` bytes together; a longer text stands alone."""
    start = size = 0
    for i, raw in enumerate(raws):
        if i > start and size + len(raw) > limit:
            yield start, i
            start, size = i, 0
        size += len(raw)
    if start < len(raws):
        yield start, len(raws)


def cut_out(text, starts, ends):
    """The text without the given ranges, the number of units removed and of maximal removed runs."""
    kept, at, removed, runs = [], 0, 0, 0
    last = -1
    for s, e in sorted(zip(starts, ends)):
        if s > last:
            runs += 1
        if s > at:
            kept.append(text[at:s])
        removed += max(0, e - max(s, at))
        at, last = max(at, e), max(last, e)
    kept.append(text[at:])
    return text[:0].join(kept), removed, runs


def arrow_schema(text: str) -> pa.Schema:
    """An Arrow schema from `name type, ...` with the type names of Spark used here."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
             "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()),
             "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (field.split() for field in text.split(","))])


def map_batches(df: DataFrame, make, schema: str) -> DataFrame:
    """mapInArrow with one task state: `make()` gives a function from a batch to column lists.

    The function returns one list or array per column of `schema`, or None for no rows.
    """
    def run(batches):
        out = arrow_schema(schema)
        step = make()
        for batch in batches:
            for part in slices(batch):
                columns = step(part)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type, from_pandas=False) for c, f in zip(columns, out)], schema=out)

    return df.mapInArrow(run, schema)
