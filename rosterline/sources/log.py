"""A stored history to which rows are added if their key is new."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from rosterline.operators.headers import check_headers, column, quoted
from rosterline.operators.history import absent_rows
from rosterline.sources.catalog import (
    VERSIONS, current_versions, database_and_table, new_version, point, read_table, relation_kind,
)

MOST_SEGMENTS = 16
_NULLS = "__nulls"


def _segments(spark: SparkSession, name: str) -> tuple[list[str], list[str]]:
    """Identifiers of the segments with keys, and of those without."""
    database, table = database_and_table(spark, name)
    found = current_versions(spark, database, table)
    full = [f"{quoted(VERSIONS.format(database))}.{quoted(version)}" for version in found]
    without = [each for each, version in zip(full, found) if version.startswith(f"{table.lower()}{_NULLS}__v")]
    return [each for each in full if each not in without], without


def _write(spark: SparkSession, name: str, rows: DataFrame, key: str, buckets: int) -> tuple[str, str]:
    """Store rows with keys in buckets of it, and rows without as they lie, so that these do not meet in one bucket."""
    database, table = database_and_table(spark, name)
    keyed, without = new_version(spark, database, table), new_version(spark, database, table + _NULLS)
    has_key = column(rows, key).isNotNull()
    rows.filter(has_key).repartition(buckets, column(rows, key)).write.format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(keyed)
    rows.filter(~has_key).write.format("parquet").saveAsTable(without)
    return keyed, without


def _point(spark: SparkSession, name: str, segments: list[str]) -> DataFrame:
    point(spark, name, "\nUNION ALL ".join(f"SELECT * FROM {each}" for each in segments))
    return read_table(spark, name)


def append_to_history(spark: SparkSession, name: str, new: DataFrame, key: str, buckets: int) -> DataFrame:
    """Add the rows whose key the history lacks (see ``absent_rows``), and make the history if there is none.

    The history lies in segments, each in the same number of buckets by key. The new rows are brought to these buckets
    and compared there, so the history is read by its key only, and never exchanged or rewritten: what is absent is
    written as one more segment, and the name then points to all of them. When there are MOST_SEGMENTS they are
    written as one. One append at a time: of two at once, the later one wins.
    """
    check_headers(new)
    if relation_kind(spark, name) not in (None, "table"):
        raise ValueError(f"{name} is no stored history")
    keyed, without = _segments(spark, name)
    if not keyed:
        return _point(spark, name, list(_write(spark, name, absent_rows(new.limit(0), new, key), key, buckets)))
    history = reduce(DataFrame.unionByName, [spark.table(each) for each in keyed])
    absent = absent_rows(history, new.select(*[column(new, each) for each in history.columns]), key)
    one, other = _write(spark, name, absent, key, buckets)
    if len(keyed) + 1 < MOST_SEGMENTS:
        return _point(spark, name, [*keyed, one, *without, other])
    _point(spark, name, [*keyed, one, *without, other])
    return _point(spark, name, list(_write(spark, name, read_table(spark, name), key, buckets)))
