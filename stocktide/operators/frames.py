"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktide.session import materialize


def over(keys: Sequence[str], *order) -> Window:
    """Window over one series; callers hold at most one row per day and key."""
    w = Window.partitionBy(*keys)
    return w.orderBy(*order) if order else w


def known(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows whose grouping columns are all present (null keys are dropped)."""
    columns = list(columns)
    return df.na.drop(how="any", subset=columns) if columns else df


def attach(df: DataFrame, params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add parameter columns: one row per key by join, one row overall by subquery.

    A keyless `params` is an ungrouped aggregate, so it has exactly one row and
    the scalar subquery never ships more than that. With keys Spark decides by
    size; `params` that meet facts are written first (`attach_written`), so that
    the size is known and a small table leaves the facts where they are.
    """
    if keys:
        return df.join(params, list(keys), "left")
    row = params.select(F.struct("*").alias("p")).scalar()
    with_row = df.withColumn("__row", row)
    return with_row.select(*df.columns, *[F.col(f"__row.{c}").alias(c) for c in params.columns])


def attach_written(df: DataFrame, params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return attach(df, materialize(params, "params") if keys else params, keys)


def with_totals(df: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """Add aggregates over each key, without gathering the key's rows in a task."""
    return attach(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()]), keys)


def only(df: DataFrame, column: str) -> Column:
    """The single value of a one-row frame."""
    return df.select(column).scalar()


def ratio(num, den, default=None) -> Column:
    """Division that yields `default` on a zero or missing divisor."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    q = F.try_divide(num.cast("double"), den.cast("double"))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def has(df: DataFrame, *columns: str) -> bool:
    return all(c in df.columns for c in columns)


def present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("double", "float", "bigint", "int", "smallint", "tinyint")
    return [c for c, t in df.dtypes if t in kinds or t.startswith("decimal")]


def string_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def long_form(df: DataFrame, ids: Sequence[str], values: Sequence[str], name="column", value="value") -> DataFrame:
    """Unpivot `values` to doubles."""
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return typed.unpivot(list(ids), list(values), name, value)


def rows_of(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A literal rule table, bounded by the code that writes it; stays in the JVM."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    cell = lambda v, f: F.lit(v).cast(f[1]).alias(f[0])
    if not rows:
        return spark.range(0).select(*[cell(None, f) for f in fields])
    structs = [F.struct(*[cell(v, f) for v, f in zip(r, fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
