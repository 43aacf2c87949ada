"""Column functions: parsing, coercion, safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stocktide.operators.frames import ratio


def parse_date(text: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Date in the stated format; anything else is missing."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("date")


def to_number(value: Column, default: float | None = None) -> Column:
    out = value.try_cast("double")
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def to_integer(value: Column, default: int = 0) -> Column:
    """Truncates towards zero."""
    return F.coalesce(value.try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def to_text(value: Column, default: str = "") -> Column:
    return F.coalesce(value.cast("string"), F.lit(default))


def safe_divide(num: Column, den: Column, default: float = 0.0) -> Column:
    hit = den.isNull() | (den == 0)
    return F.when(hit, F.lit(float(default))).otherwise(F.try_divide(num.cast("double"), den.cast("double")))


def percent_change(old: Column, new: Column) -> Column:
    """Relative to the size of the old value; 0 when that is zero or unknown."""
    return F.coalesce(ratio(new - old, F.abs(old)) * 100, F.lit(0.0))


def compound_growth(start: Column, end: Column, periods: Column) -> Column:
    ok = (start > 0) & (end > 0) & (periods > 0)
    rate = F.pow(ratio(end, start), ratio(F.lit(1.0), periods))
    return F.when(ok, (rate - 1) * 100).otherwise(0.0)
