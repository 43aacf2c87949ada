"""Filtered, ordered pages of one dataset."""

from __future__ import annotations

import bisect
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clean import between_dates, matching
from .frames import attach

SAMPLE = 4096  # keys that the bounds of the ranges are taken from
RANGES = 64
LARGEST = 1 << 16  # rows of the range that is sorted in the end


def _key(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _fixed(row, fields: Sequence[T.StructField]) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)])


def _between(df: DataFrame, order: Sequence[str], low, high) -> DataFrame:
    """Rows with low <= key < high (None: open). A bound on the first column goes along, for the scan."""
    fields = [df.schema[c] for c in order]
    first = F.col(order[0])
    if low is not None:
        df = df.where(_key(order) >= _fixed(low, fields))
        if low[0] is not None:
            df = df.where(first >= F.lit(low[0]).cast(fields[0].dataType))
    if high is not None:
        df = df.where(_key(order) < _fixed(high, fields))
        if high[0] is not None:
            df = df.where(first.isNull() | (first <= F.lit(high[0]).cast(fields[0].dataType)))
    return df


def _range_of(key: Column, bounds: Sequence[Column], start: int = 0) -> Column:
    """Number of bounds that are not above the key, by halving."""
    if not bounds:
        return F.lit(start)
    middle = len(bounds) // 2
    return F.when(key < bounds[middle], _range_of(key, bounds[:middle], start)).otherwise(_range_of(key, bounds[middle + 1:], start + middle + 1))


def locate(df: DataFrame, order: Sequence[str], position: int, rows: int, largest: int | None = None):
    """(key, rows before the first row with that key) of the row at a 0-based position, or None beyond the end.

    The rows are never sorted or written as a whole: the keys with the smallest hashes are a sample
    whose quantiles cut the data into ranges; a narrow pass counts them; the range that holds the
    position is cut again until it is small enough to be sorted. `rows` is the number of rows.
    """
    largest = largest or LARGEST
    if position >= rows:
        return None
    keys, fields = df.select(*order), [df.schema[c] for c in order]
    low = high = None
    before, held = 0, rows
    while held > largest:
        part = _between(keys, order, low, high)
        sample = part.orderBy(F.xxhash64(*order)).limit(SAMPLE).orderBy(*order).collect()
        picked = [tuple(sample[i * len(sample) // RANGES]) for i in range(1, RANGES)]
        bounds = [b for b, previous in zip(picked, [low, *picked]) if b != previous]
        if not bounds:  # one key fills the range
            break
        spots = part.groupBy(_range_of(_key(order), [_fixed(b, fields) for b in bounds]).alias("_range")).count().collect()  # a row for each range
        counts = dict(map(tuple, spots))
        ends = list(accumulate(counts.get(i, 0) for i in range(len(bounds) + 1)))
        at = bisect.bisect_right(ends, position - before)
        low, high = bounds[at - 1] if at else low, bounds[at] if at < len(bounds) else high
        before, held = before + (ends[at - 1] if at else 0), counts[at]
    found = _between(keys, order, low, high).orderBy(*order).limit(position - before + 1)
    last = found.groupBy(*order).count().orderBy(*[F.desc(c) for c in order]).first()
    return tuple(last[c] for c in order), position + 1 - last["count"]


def page(df: DataFrame, order: Sequence[str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """One page in date order with the total number of matching records.

    `order` ends in a unique column so that pages do not overlap. Without a
    limit the page is everything after the offset. Skipped rows are never
    gathered: the key at the offset is located by counts, and a second scan
    reads on from there.
    """
    total = df.agg(F.count(F.lit(1)).alias("total_records"))
    rows = df
    if offset:
        n = total.first()[0]
        total = df.sparkSession.range(1).select(F.lit(n).alias("total_records")).agg(F.max("total_records").alias("total_records"))
        found = locate(df, order, offset, n)
        if found is None:
            return attach(df.limit(0), total).withColumn("Date", F.date_format("Date", "yyyy-MM-dd"))
        key, before = found
        rows = _between(df, order, key, None)
        if offset > before:  # rows that share the key of the page's first row
            rows = rows.orderBy(*order).offset(offset - before)
    rows = rows.orderBy(*order).limit(limit) if limit else rows.orderBy(*order)
    return attach(rows, total).withColumn("Date", F.date_format("Date", "yyyy-MM-dd"))


def dataset_page(df: DataFrame, period: str, order, limit=None, offset=0, date_from=None, date_to=None, **equal) -> DataFrame:
    """Rows of one period, optionally within dates and matching dimensions."""
    rows = matching(between_dates(df.where(F.col("period") == period), date_from, date_to), **equal)
    return page(rows, order, limit, offset)
