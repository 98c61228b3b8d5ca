"""A stored history that grows."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from rosterline.operators.history import absent_rows, append_if_absent
from rosterline.sources import catalog, log
from tests.conftest import rows
from tests.test_plans import plan_of

SCHEMA = "question string, n int"


def test_appends_equal_the_plain_form(spark, database):
    name, plain = f"{database}.asked", None
    for turn in range(4):
        new = spark.createDataFrame([(f"q{i % 23}", i) for i in range(turn * 7, turn * 7 + 30)] + [(None, turn), (None, turn)], SCHEMA)
        stored = log.append_to_history(spark, name, new, "question", 4)
        before = spark.createDataFrame([], SCHEMA) if plain is None else plain
        plain = spark.createDataFrame(append_if_absent(before, new, "question").collect(), SCHEMA)
        assert rows(stored) == rows(plain)
    assert rows(catalog.list_tables(spark, database)) == [("asked", "table")]


def test_an_append_exchanges_the_new_rows_only(spark, database):
    name = f"{database}.asked"
    for part in range(3):
        log.append_to_history(spark, name, spark.range(part * 50, part * 50 + 60).select(F.col("id").cast("string").alias("question"), F.lit(part).alias("n")), "question", 8)
    keyed, _ = log._segments(spark, name)
    assert len(keyed) == 3
    history = spark.table(keyed[0]).unionByName(spark.table(keyed[1])).unionByName(spark.table(keyed[2]))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(absent_rows(history, spark.range(9).select(F.col("id").cast("string").alias("question"), F.lit(1).alias("n")), "question"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    known = plan[plan.index("Union", plan.index("LeftAnti")):] if "LeftAnti" in plan else ""
    assert plan.count("Bucketed: true") == 3 and all(set(each.split(",")) == {"question:string"} for each in re.findall("ReadSchema: struct<(.*?)>", plan))
    assert "Exchange" not in known[: known.rindex("Bucketed: true")]


def test_segments_are_joined_and_readers_finish(spark, database, monkeypatch):
    monkeypatch.setattr(log, "MOST_SEGMENTS", 3)
    name = f"{database}.asked"
    first = log.append_to_history(spark, name, spark.createDataFrame([("a", 1), (None, 0)], SCHEMA), "question", 2)
    for i in range(4):
        log.append_to_history(spark, name, spark.createDataFrame([("a", 9), (f"b{i}", i)], SCHEMA), "question", 2)
    assert len(log._segments(spark, name)[0]) < 3
    assert rows(catalog.read_table(spark, name)) == sorted([("a", 1), *[(f"b{i}", i) for i in range(4)], (None, 0)], key=lambda r: [(v is None, str(v)) for v in r])
    assert rows(first) == [("a", 1), (None, 0)]


def test_not_a_history(spark, database):
    catalog.replace_view(spark, f"{database}.v", "SELECT 'a' AS question, 1 AS n")
    with pytest.raises(ValueError, match="no stored history"):
        log.append_to_history(spark, f"{database}.v", spark.createDataFrame([("a", 1)], SCHEMA), "question", 2)
