"""Aggregates over text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rosterline.functions.numbers import to_number


def sum_text(col: Column) -> Column:
    """Sum of the numeric values; NULL when the group has none."""
    return F.sum(to_number(col))


def avg_text(col: Column) -> Column:
    return F.avg(to_number(col))


def headcount(col: Column) -> Column:
    return F.count(col)


def any_non_null(col: Column) -> Column:
    """Some non-null value of the group. The least one, so that reruns agree."""
    return F.min(col)
