"""Number helpers shared by all column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    """A Column as is, a string as a column name, anything else as a literal."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def dbl(x) -> Column:
    if isinstance(x, int) and not isinstance(x, bool):
        return F.lit(float(x))
    return col(x).cast("double")


def round_half_up(x, digits: int = 0) -> Column:
    """Round halves towards plus infinity (-2.5 gives -2), not away from zero."""
    k = float(10**digits)
    if digits == 0:
        return F.floor(col(x) + F.lit(0.5)).cast("double")
    return F.floor(col(x) * F.lit(k) + F.lit(0.5)) / F.lit(k)


def clamp(x, lo, hi) -> Column:
    """Bound x; unlike ``least``/``greatest`` a NULL stays NULL."""
    v = col(x)
    return F.when(v.isNotNull(), F.least(F.greatest(v, col(lo)), col(hi)))


def square(x) -> Column:
    v = col(x)
    return v * v


def fixed(x, digits: int) -> Column:
    """Fixed-decimal text without thousands separators."""
    return F.format_string(f"%.{digits}f", col(x))


def int_text(x) -> Column:
    """A whole number as text."""
    return col(x).cast("bigint").cast("string")


def number_text(x) -> Column:
    """A number as text: whole values without a decimal point."""
    v = dbl(x)
    return F.when(v == F.floor(v), int_text(v)).otherwise(v.cast("string"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    A Column used twice in a formula is copied as a whole expression; long formulas
    grow past what the optimizer can hold. A lambda variable is not copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_all(body, **values) -> Column:
    """Bind several named values at once; ``body`` gets them as a struct."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)
