"""Helpers that several of the operators share."""

from __future__ import annotations

import math
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterline.session import fresh_path

WORD = r"[^\x20\x09-\x0D]+"


_recorded: ContextVar[list[str] | None] = ContextVar("recorded", default=None)


@contextmanager
def recording():
    """The folders that are staged in this block, in a list."""
    paths: list[str] = []
    token = _recorded.set(paths)
    try:
        yield paths
    finally:
        _recorded.reset(token)
        if (around := _recorded.get()) is not None:
            around.extend(paths)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder and read them again.

    Cuts the lineage, so that a lost executor costs no more than one step, and fixes row ids and sizes.
    """
    return staged_at(df, label)[0]


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, recorded where that is asked for."""
    path = fresh_path(spark, label)
    if (seen := _recorded.get()) is not None:
        seen.append(path)
    return path


def staged_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``staged`` and its folder, for ``remove_path`` once nothing reads it any more."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def column_function(returns: str):
    """A vectorised function of columns; it becomes a UDF when called, as modules load in tasks without a session."""

    def wrap(function):
        return lambda *columns: F.pandas_udf(function, returns)(*columns)

    return wrap


def group_key(column) -> Column:
    """A text that is never null, different for every value and for null."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def hash_key(column) -> Column:
    """32 bits, as good as random, of a column's text; null counts as the text ``null``."""
    value = F.col(column) if isinstance(column, str) else column
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def bucket_bits(rows: int, rows_per_bucket: int = 4096) -> int:
    """How many leading bits of a hash key split so many rows into buckets of the given size."""
    return max(0, min(31, math.ceil(math.log2(max(rows, 1) / rows_per_bucket)))) if rows > rows_per_bucket else 0


def prefix_sums(df: DataFrame, group: str, key: str, weight: str, order: list, bits: int, into: str = "before") -> DataFrame:
    """Add the sum of the weights that come earlier in the row's group, in order of the hash key.

    A group is never sorted in one task: its range of keys is cut into 2**bits even buckets, each is summed
    where it lies, the few sums are added up per group, and each bucket then continues from its start.
    The frame is read twice, so stage it first.
    """
    bucketed = df.withColumn("_bucket", F.shiftright(F.col(key), 32 - bits) if bits else F.lit(0).cast("long"))
    sums = bucketed.groupBy(F.col(group).alias("_group"), F.col("_bucket").alias("_at")).agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy("_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_group", "_at", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_bucket").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.join(starts, (F.col(group) == F.col("_group")) & (F.col("_bucket") == F.col("_at")))
        .withColumn(into, (F.col("_start") + F.coalesce(F.sum(weight).over(within), F.lit(0))).cast("long"))
        .drop("_bucket", "_group", "_at", "_start")
    )


def coarse(value: str) -> str:
    """SQL for the bin of a whole number: its seven leading bits, so a bin is under 1/64 of its value wide."""
    return f"shiftleft(shiftright({value}, greatest(0, length(bin({value})) - 7)), greatest(0, length(bin({value})) - 7))"
