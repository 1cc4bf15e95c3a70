"""Number coercion and rounding expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_stable(value: Column, digits: int) -> Column:
    """Half-up rounding that ignores the noise of floating-point summation order.

    Two runs that add the same numbers in another order may differ in the last
    bit; a value sitting on a tie would then flip. The nudge is six digits below
    the kept precision, so reruns (and other engines) agree.
    """
    nudge = F.signum(value) * F.lit(10.0 ** -(digits + 6))
    return F.round(value + nudge, digits) + F.lit(0.0)


def as_double(text: Column) -> Column:
    """Blank or unreadable text is NULL, never zero."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def as_double_or(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(as_double(text), F.lit(default))


def as_int(text: Column) -> Column:
    """Integer through a double, so ``12.7`` reads as 12."""
    return as_double(text).try_cast("bigint")


def json_number(value: Column, kind: Column) -> Column:
    """Numeric JSON value; booleans and text do not count as numbers."""
    return F.when(kind.isin("BIGINT", "DOUBLE", "DECIMAL"), value.try_cast("double"))
