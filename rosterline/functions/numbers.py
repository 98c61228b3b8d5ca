"""Numbers kept as text, rounding, and guarded division."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANKS = " \t\n\r\v\f"


def to_number(col: Column) -> Column:
    """Text to double; text that is not a number becomes NULL.

    As in DuckDB, underscores may part digits (``1_000``), and a type suffix (``1.0d``, ``1f``), which
    Spark's cast would take, is no number.
    """
    digits = F.when(F.contains(col, F.lit("_")), F.regexp_replace(col, r"(?<=[0-9])_(?=[0-9])", "")).otherwise(col)
    last = F.right(F.rtrim(digits, F.lit(BLANKS)), F.lit(1))
    suffixed = last.isin("d", "D", "f", "F") & ~F.contains(F.lower(digits), F.lit("inf"))
    return F.when(~suffixed, digits.try_cast("double"))


def zero_fill(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def round5(col: Column) -> Column:
    """Five decimals, rounded as DuckDB rounds a double: scaled, to the nearest whole, scaled back.

    Rounding the decimal text of the double, as Spark does, gives other results at some ties.
    """
    return nearest(col * 100000.0) / 100000.0


def nearest(col: Column) -> Column:
    """A double's nearest whole number, halves away from zero, as ``round`` gives it, which goes through decimals."""
    even = F.rint(col)
    over = col - even
    return F.when((F.abs(over) == 0.5) & (over * col > 0), even + 2 * over).otherwise(even) + F.lit(0.0)


def whole(col: Column) -> Column:
    """Nearest whole number, halves away from zero. Adding 0.0 turns a negative zero into zero."""
    return F.round(col) + F.lit(0.0)


def per_unit(total: Column, units: Column) -> Column:
    """``total / units`` as a whole number; NULL where there are no units."""
    return whole(total / F.nullif(units, F.lit(0.0)))
