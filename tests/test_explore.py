from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rosterline.operators import explore
from rosterline.operators.history import append_if_absent, recent_distinct
from rosterline.operators.lookups import audit_duplicates, lookup, lookup_unique
from tests.conftest import rows


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "Asha", "None"), (2, "nandan", None), (3, None, "x(y")], "id int, `First Name` string, `a.b` string")


def test_search(people):
    def found(pattern):
        return [row[0] for row in rows(explore.search_any(people, pattern))]

    assert found("ASHA") == [1]
    assert found("^2$") == [2]
    assert found("nan") == [2]  # a missing cell does not read as "nan"
    assert found("none") == [1]
    assert found(r"x\(") == [3]
    assert found("zzz") == []
    assert found("") == found(None) == [1, 2, 3]


def test_counts(people):
    assert rows(explore.match_counts(people, "asha|x")) == [(2, 3)]
    assert rows(explore.match_counts(people, "zzz")) == [(0, 3)]
    assert rows(explore.match_counts(people, None)) == [(3, 3)]


def test_preview_and_chart(spark):
    df = spark.createDataFrame([("a", "3"), ("b", "x"), ("c", "1"), (None, "4")], "x string, y string")
    assert [tuple(row) for row in explore.preview_rows(df, [F.asc_nulls_last("x")]).collect()] == [("a", "3"), ("b", "x"), ("c", "1")]
    assert explore.preview_rows(df.limit(2), [F.asc("x")]).count() == 0
    assert rows(explore.chart_series(df, "x", "y")) == [("a", 3.0), ("c", 1.0)]
    assert explore.chart_series(df.filter("y in ('3', '1')"), "x", "y").count() == 0


def test_query_status(spark):
    spark.range(5).createOrReplaceTempView("five")
    ok = explore.query_status(spark, "SELECT id, id * 2 AS twice FROM five ORDER BY id", printed_rows=2)
    assert (ok.status, ok.rows.count(), ok.text) == ("ok", 5, " id  twice\n  0      0\n  1      2")
    empty = explore.query_status(spark, "SELECT * FROM five WHERE id > 9")
    assert (empty.status, empty.text) == ("empty", "No data found.")
    for text in ("SELECT nope FROM five", "SELEC 1", "SELECT CAST('x' AS INT) FROM five"):
        failed = explore.query_status(spark, text)
        assert failed.status == "error" and failed.rows is None and failed.text.startswith("Error: ")


def test_append_if_absent(spark):
    target = spark.createDataFrame([("a",), (None,)], "question string")
    new = spark.createDataFrame([("a",), ("b",), ("b",), (None,), (None,)], "question string")
    assert [row[0] for row in rows(append_if_absent(target, new, "question"))] == ["a", "b", None, None, None]
    wide = spark.createDataFrame([("c", 2), ("c", 1), ("a", 9)], "question string, n int")
    assert rows(append_if_absent(target.withColumn("n", F.lit(0)), wide, "question")) == [("a", 0), ("c", 1), (None, 0)]


def test_recent_distinct(spark):
    log = spark.createDataFrame([("a", 1), ("b", 2), ("a", 5), ("c", 3)], "question string, at int")
    assert [tuple(row) for row in recent_distinct(log, "question", F.col("at"), 2).collect()] == [("a", 5), ("c", 3)]


def test_lookups(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    table = spark.createDataFrame([("a", None), ("a", "1"), (None, "9")], "`Key Id` string, `The Value` string")
    raw = lookup(df, table, {"key_id": F.col("k")}, {"value": "the value"})
    assert rows(raw) == [("a", "1"), ("a", None), ("b", None), (None, None)]
    unique = lookup_unique(df, table, "Key Id", F.col("k"), {"value": "The Value"})
    assert rows(unique) == [("a", "1"), ("b", None), (None, None)]
    assert [tuple(row) for row in audit_duplicates(table, "Key Id").collect()] == [("a", 2)]


def test_hot_and_missing_lookup_keys_are_split(spark):
    """A third of the rows on one key and a third on none, in a lookup too large to broadcast."""
    third = F.col("id") % 3
    key = F.when(third == 0, "hot").when(third == 1, F.col("id").cast("string"))
    rows_ = spark.range(90_000).select(key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pay"))
    table = spark.range(30_000).select(F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.lit("x").alias("v"))
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {name: spark.conf.get(name) for name in small}
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        joined = lookup_unique(rows_, table.union(table), "key", F.col("k"), {"v": "v"})
        found = joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(found) == 90_000 and sum(row["v"] is not None for row in found) == 30_000 + 10_000
    assert "SortMergeJoin(skew=true)" in plan


def test_query_status_reads_the_whole_query(spark):
    late = "SELECT IF(id = 4900, CAST('x' || id AS INT), id) AS v FROM range(5000)"
    assert explore.query_status(spark, late).status == "error"
    many = explore.query_status(spark, "SELECT id FROM range(5000)")
    assert many.status == "ok" and many.note == "1000 of 5000 rows"
