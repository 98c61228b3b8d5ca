"""Steps over a log of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rosterline.operators.headers import column


def absent_rows(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``new`` whose key ``target`` lacks, one row per key.

    As equality with NULL is never true, every row with a NULL key counts as absent.
    """
    keyed = one_per_key(new, key)
    known = target.select(column(target, key)).filter(column(target, key).isNotNull()).distinct()
    return keyed.join(known, key, "left_anti").unionByName(new.filter(column(new, key).isNull()))


def one_per_key(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key, the least; rows without a key are left out."""
    rest = [name for name in rows.columns if name != key]
    keyed = rows.filter(column(rows, key).isNotNull())
    if not rest:
        return keyed.distinct()
    first = F.min(F.struct(*[column(rows, name) for name in rest])).alias("__rest")
    return keyed.groupBy(column(rows, key)).agg(first).select(column(rows, key), "__rest.*")


def append_if_absent(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``target`` plus its ``absent_rows``. For a history that is stored and grows, see ``sources.log``."""
    return target.unionByName(absent_rows(target, new, key))


def recent_distinct(df: DataFrame, value: str, asked_at: Column, n: int = 10) -> DataFrame:
    """The ``n`` distinct values seen last, the latest first."""
    latest = df.groupBy(column(df, value)).agg(F.max(asked_at).alias("last_asked"))
    return latest.orderBy(F.desc_nulls_last("last_asked"), column(df, value).asc_nulls_last()).limit(n)
