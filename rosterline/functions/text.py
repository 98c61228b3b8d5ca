"""Text predicates and the table-name rule."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def contains_ci(col: Column, text: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` in ``text`` are wildcards."""
    return col.ilike(f"%{text}%")


def any_matches(columns: list[Column], pattern: str) -> Column:
    """True when the text form of any column matches the regex, ignoring case. NULL never matches."""
    hits = F.lit(False)
    for col in columns:
        hits = hits | F.coalesce(col.cast("string").rlike(f"(?i){pattern}"), F.lit(False))
    return hits


def label_missing(col: Column, label: str) -> Column:
    return F.coalesce(col, F.lit(label))


def table_name_expr(file_name: Column) -> Column:
    """Table name of a workbook: lower case, no workbook suffixes, blanks as underscores, trimmed."""
    name = F.lower(file_name)
    for suffix in (".xlsx", ".xlsb"):
        name = F.replace(name, F.lit(suffix), F.lit(""))
    name = F.replace(name, F.lit(" "), F.lit("_"))
    return F.regexp_replace(name, r"(?U)^\s+|\s+$", "")
