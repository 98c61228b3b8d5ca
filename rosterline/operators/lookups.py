"""Lookup joins.

No broadcast is forced. Spark broadcasts a lookup whose size it knows to be under
``spark.sql.autoBroadcastJoinThreshold`` and shuffles a larger one, where adaptive execution splits
the partitions of hot keys.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from rosterline.functions import any_non_null
from rosterline.operators.headers import pick

_KEY = "__lookup_key_{}"
_HASH = "__lookup_hash"


def lookup(df: DataFrame, table: DataFrame, on: Mapping[str, Column], values: Mapping[str, str]) -> DataFrame:
    """Left join ``table``: ``on`` maps its key headers to columns of ``df``, ``values`` new names to headers.

    Repeated keys in ``table`` repeat the rows of ``df``; see ``lookup_unique``.
    """
    keys = {_KEY.format(i): header for i, header in enumerate(on)}
    right = table.select(
        *[pick(table, header).alias(key) for key, header in keys.items()],
        *[pick(table, header).alias(name) for name, header in values.items()],
    )
    condition = [on[header] == F.col(key) for key, header in keys.items()]
    return df.join(right, condition, "left").drop(*keys)


def unique_map(table: DataFrame, key: str, values: Mapping[str, str]) -> DataFrame:
    """One row per key, with one non-null value per column."""
    return table.groupBy(pick(table, key).alias(key)).agg(
        *[any_non_null(pick(table, header)).alias(name) for name, header in values.items()]
    )


def lookup_unique(df: DataFrame, table: DataFrame, key: str, on: Column, values: Mapping[str, str]) -> DataFrame:
    """``lookup`` on a table made unique first, so that it cannot repeat rows.

    The hash of the key adds nothing to the match. With it the unique rows are exchanged for the join,
    rather than joined in the partitions they were grouped in, and only between two exchanged sides does
    adaptive execution split the partition of a hot or missing key.
    """
    unique = unique_map(table, key, values)
    hashed = unique.withColumn(_HASH, F.xxhash64(pick(unique, key)))
    return lookup(df, hashed, {key: on, _HASH: F.xxhash64(on)}, {name: name for name in values})


def audit_duplicates(table: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, the most frequent first."""
    name = pick(table, key).alias(key)
    counts = table.groupBy(name).agg(F.count("*").alias("mappings")).filter(F.col("mappings") > 1)
    return counts.orderBy(F.desc_nulls_last("mappings"), pick(counts, key).asc_nulls_last())
