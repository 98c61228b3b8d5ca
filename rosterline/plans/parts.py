"""Each fact's share of the reports, stored, so that a new upload of one fact reads that fact only.

A part has one row per key of the finest grain with every measure and description that any report takes from the
fact: sums, counts and least values, which merge into those of a coarser grain. All parts lie in the same number of
buckets by a hash of the coarser key. Rows of one key are in one bucket of each part whichever grain a report has, so
the reports merge the parts bucket by bucket, without an exchange. Ids of departments are mined along the way.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterline.operators.grain import GRAIN_4, GRAIN_5, Source, summarise
from rosterline.operators.headers import column, quoted
from rosterline.plans.consolidate import KEY_HASH
from rosterline.plans.facts import ATTRITION, COUNTED_RELEASES, CURRENT, DEMAND, FULFILMENT, PREVIOUS, RELEASES
from rosterline.plans.reports import DEPARTMENT_ID
from rosterline.sources.catalog import read_table, replace_table

FACTS = {source.table: source for source in (CURRENT, PREVIOUS, DEMAND, FULFILMENT, RELEASES, ATTRITION, COUNTED_RELEASES)}
PART = "part_{}"


def part_of(df: DataFrame, source: Source) -> DataFrame:
    """The fact at the finest grain, with the hash that it is bucketed by."""
    if source == CURRENT:
        source = replace(source, attributes={**source.attributes, "department_id": DEPARTMENT_ID})
    part = summarise(df, source, GRAIN_5)
    return part.withColumn(KEY_HASH, F.xxhash64(*[column(part, key) for key in GRAIN_4]))


def refresh_parts(spark: SparkSession, database: str, facts: Mapping[str, DataFrame], buckets: int) -> None:
    """Store the parts of the given facts, by the names the reports use; parts of other facts stay as they are.

    ``buckets`` is the same for all parts of a database: with some 100 MB of a part to a bucket, tasks fit in memory.
    """
    for name, df in facts.items():
        replace_table(spark, f"{quoted(database)}.{quoted(PART.format(name))}", part_of(df, FACTS[name]), buckets=(buckets, KEY_HASH))


def part_tables(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """All stored parts, as the reports take facts; the lookups are passed beside them."""
    found = {name: f"{quoted(database)}.{quoted(PART.format(name))}" for name in FACTS}
    return {name: read_table(spark, part) for name, part in found.items() if spark.catalog.tableExists(part)}
