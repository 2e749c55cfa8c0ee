"""Functions whose rules differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lenient_sum(column: Column, kind: T.DataType) -> Column:
    """Sum by the type of its input: integers to BIGINT, wrapping round; floats and strings to DOUBLE.

    Nulls, and strings that are no number, are skipped; nothing to sum gives null.  Booleans and
    nested types are refused.
    """
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        # Two halves cannot overflow; the sum of the high ones wraps when it is shifted back.
        value = column.cast("long")
        low = F.sum(value.bitwiseAND(F.lit(0xFFFFFFFF)))
        high = F.sum(F.shiftright(value, 32))
        carried = (high + F.shiftright(low, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(carried, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))
    if isinstance(kind, (T.FloatType, T.DoubleType, T.StringType)):
        return F.sum(column.try_cast("double"))
    raise TypeError(f"sum takes numbers or strings, not {kind.simpleString()}")


def divide(a: Column, b: Column) -> Column:
    """Division in DOUBLE; by zero gives null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def year_of(text: Column) -> Column:
    """Year of a date or of a string that begins with one; null if it is none."""
    return F.year(text.try_cast("date"))


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern is found anywhere; an empty alternative finds itself in every text that is not null."""
    return text.rlike(pattern)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)
