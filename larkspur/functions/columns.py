"""The dialect's semantics for DataFrame users, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_int(x: Column | str, kind: str = "int") -> Column:
    """A number as a whole one, halves away from zero."""
    return F.round(_c(x)).cast(kind)


def between3(x: Column | str, low: Column, high: Column) -> Column:
    """BETWEEN that is UNKNOWN if any of the three is."""
    x = _c(x)
    return F.when(x.isNull() | low.isNull() | high.isNull(), F.lit(None).cast("boolean")).otherwise((x >= low) & (x <= high))


def sum_exact(x: Column | str, precision: int, scale: int) -> Column:
    """SUM of a DECIMAL(precision, scale) in that same type; overflow fails."""
    return F.sum(_c(x).cast(f"decimal({precision},{scale})")).cast(f"decimal({precision},{scale})")


def avg_exact(x: Column | str, scale: int = 0) -> Column:
    """AVG of exact numbers as DECIMAL(38,6), rounded half up."""
    v = _c(x).cast(f"decimal({19 + scale},{scale})")
    return (F.sum(v).cast(f"decimal(38,{scale})") / F.nullif(F.count(v), F.lit(0))).cast("decimal(38,6)")


def substring(x: Column | str, start: int, length: int | None = None) -> Column:
    """From 1; 0 counts as 1; a start before the first character is the first."""
    x = _c(x)
    first = F.lit(max(1, start)) if start >= 0 else F.greatest(F.length(x) + start + 1, F.lit(1))
    return F.substring(x, first, F.length(x) if length is None else F.lit(length))


def round_float(x: Column | str, digits: int = 0) -> Column:
    """Floats round halves up, toward positive infinity."""
    unit = F.lit(10.0**digits)
    return F.floor(_c(x) * unit + F.lit(0.5)) / unit


def asc(x: Column | str) -> Column:
    """NULL is the largest value."""
    return _c(x).asc_nulls_last()


def desc(x: Column | str) -> Column:
    return _c(x).desc_nulls_first()


def blank_equal(a: Column | str, b: Column | str) -> Column:
    """CHAR comparison: trailing blanks don't count."""
    return F.rtrim(_c(a)) == F.rtrim(_c(b))
