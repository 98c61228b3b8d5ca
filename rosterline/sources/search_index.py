"""Search over a stored table that reads only the files that can hold a match."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterline.operators.explore import search_any
from rosterline.operators.headers import column, quoted
from rosterline.sources.catalog import VERSIONS, current_versions, database_and_table, index_of, read_table, shows_whole_versions

BITS = 1 << 17  # of the filter of a file and column
MOST_FILES = 10_000  # named in a plan; if more can match, all are read
_TRIGRAM = "(?=([ -~]{3}))"  # three printable ASCII characters


def required_literals(pattern: str) -> list[str]:
    """Texts that any match of the regular expression holds, whatever the case of its letters; none if unsure.

    Plain characters side by side outside of groups and classes, less those that may be left out.
    """
    runs, run, at = [], "", 0

    def closing(start: int) -> int:
        """The place of the bracket that closes the one at ``start``, or -1."""
        depth, i, in_class = 0, start, 0
        while i < len(pattern):
            c = pattern[i]
            if c == "\\":
                i += 1
            elif in_class or c == "[":
                in_class += (c == "[") - (c == "]")
            elif c in "()":
                depth += 1 if c == "(" else -1
            if not depth and not in_class:
                return i
            i += 1
        return -1

    while at < len(pattern):
        c, size = pattern[at], 1
        if c == "|" or c == ")":
            return []
        literal = None
        if c == "\\":
            c, size = pattern[at + 1 : at + 2], 2
            if not c or c in "QExupPkcN0123456789":
                return []
            literal = None if c.isalnum() else c
        elif c in "[(":
            end = closing(at)
            if end < 0 or re.match(r"\(\?[a-zA-Z-]*[xu-]", pattern[at:]) or pattern[at + 1 : at + 3] in ("]", "^]"):
                return []
            size = end - at + 1
        elif c not in ".^$*+?{":
            literal = c
        at += size
        quantifier = re.match(r"(\*|\+|\?|\{(\d+)?(,\d*)?\})[?+]?", pattern[at:])
        if literal is None:
            runs, run = [*runs, run], ""
        elif not quantifier:
            run += literal
        else:
            kept = literal if quantifier[1] == "+" else ""
            runs, run = [*runs, run + kept], ""
        if quantifier:
            at += quantifier.end()
    return [each.lower() for each in [*runs, run] if each]


def _positions(trigrams: Column) -> Column:
    return F.transform(trigrams, lambda each: F.pmod(F.xxhash64(each), F.lit(BITS)))


def _mask(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(position, F.lit(64)).cast("int"))


def build_search_index(spark: SparkSession, name: str) -> None:
    """Store, for every file of a table and each column, which triples of characters its cells hold, as a filter.

    Versions never change, so the filters of one are made once, and go with it. A filter is kept as its words that are
    not empty; the triples of a row are cut down to its distinct ones, and merged per task before they are exchanged.
    """
    database, table = database_and_table(spark, name)
    for version in current_versions(spark, database, table):
        index = f"{quoted(VERSIONS.format(database))}.{quoted(index_of(version))}"
        if spark.catalog.tableExists(index):
            continue
        df = spark.table(f"{quoted(VERSIONS.format(database))}.{quoted(version)}")
        cells = [F.struct(F.lit(i).alias("column"), F.lower(column(df, each).cast("string")).alias("text")) for i, each in enumerate(df.columns)]
        each = df.select(F.col("_metadata.file_path").alias("file"), F.explode(F.array(*cells)).alias("cell"))
        trigrams = F.array_distinct(F.regexp_extract_all("cell.text", F.lit(_TRIGRAM), F.lit(1)))
        places = each.select("file", "cell.column", F.explode(F.array_distinct(_positions(trigrams))).alias("position"))
        words = places.groupBy("file", "column", F.floor(F.col("position") / 64).alias("word")).agg(F.bit_or(_mask(F.col("position"))).alias("bits"))
        words.repartition("word").sortWithinPartitions("word").write.format("parquet").saveAsTable(index)


def matching_files(spark: SparkSession, index: DataFrame, pattern: str) -> DataFrame | None:
    """The files with a column whose filter has all that a match needs; None if the pattern tells nothing."""
    needed = {text[i : i + 3] for text in required_literals(pattern) for i in range(len(text) - 2) if re.fullmatch("[ -~]{3}", text[i : i + 3])}
    if not needed:
        return None
    wanted = spark.createDataFrame([(sorted(needed),)], "trigrams array<string>").select(F.explode(_positions(F.col("trigrams"))).alias("position"))
    words = wanted.groupBy(F.floor(F.col("position") / 64).alias("word")).agg(F.bit_or(_mask(F.col("position"))).alias("mask")).collect()
    tests = reduce(Column.__or__, [(F.col("word") == row["word"]) & (F.col("bits").bitwiseAND(row["mask"]) == row["mask"]) for row in words])
    hits = index.filter(F.col("word").isin([row["word"] for row in words]) & tests).groupBy("file", "column").count()
    return hits.filter(F.col("count") == len(words)).select("file").distinct()


def search_stored(spark: SparkSession, name: str, pattern: str | None) -> DataFrame:
    """``search_any`` over a stored table, without reading files that its index rules out.

    What the pattern needs literally is looked up in the filters; the rows of the files left are then tested one by
    one. Without an index, or with a pattern that needs nothing three characters long, every file is read.
    """
    database, table = database_and_table(spark, name)
    if not pattern or not shows_whole_versions(spark, database, table):
        return search_any(read_table(spark, name), pattern)
    found = []
    for version in current_versions(spark, database, table):
        versions = quoted(VERSIONS.format(database))
        rows = spark.table(f"{versions}.{quoted(version)}")
        columns = rows.columns
        if spark.catalog.tableExists(f"{versions}.{quoted(index_of(version))}"):
            files = matching_files(spark, spark.table(f"{versions}.{quoted(index_of(version))}"), pattern)
            named = [row["file"] for row in files.limit(MOST_FILES + 1).collect()] if files is not None else None
            if named is not None and len(named) <= MOST_FILES:
                rows = rows.filter(F.col("_metadata.file_path").isin(named)) if named else rows.limit(0)
        found.append(search_any(rows.select(*[column(rows, each) for each in columns]), pattern))
    return reduce(DataFrame.unionByName, found)
