"""Results of free queries, kept from the one run."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterline.operators import explore
from rosterline.session import path_exists


def test_printed_rows_are_those_that_were_counted(spark):
    out = explore.query_status(spark, "SELECT id, uuid() AS mark FROM range(0, 50, 1, 4)")
    first = {(r["id"], r["mark"]) for r in out.rows.collect()}
    assert out.total == 50 and {(r["id"], r["mark"]) for r in out.rows.collect()} == first
    printed = {tuple(line.split()) for line in out.text.splitlines()[1:]}
    assert printed == {(str(i), mark) for i, mark in first}


def test_one_execution(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return x

    spark.udf.register("seen", seen, "long")
    out = explore.query_status(spark, "SELECT seen(id) AS id FROM range(30)")
    assert out.rows.count() == 30 and out.page(3, 4).count() == 4 and calls.value == 30


def test_pages_keep_the_order(spark):
    spark.range(0, 1000, 1, 7).createOrReplaceTempView("numbers_to_page")
    out = explore.query_status(spark, "SELECT id, -id AS id, NULL AS n FROM numbers_to_page ORDER BY id DESC", printed_rows=10)
    want = list(range(999, -1, -1))
    for start, size in ((0, 5), (130, 400), (995, 50), (1000, 5), (0, 2000)):
        page = out.page(start, size)
        assert page.columns == ["id", "id", "n"]
        assert [row[0] for row in page.collect()] == want[start : start + size]
    assert out.note == "10 of 1000 rows" and out.total == 1000


def test_wide_rows_are_not_all_printed(spark, monkeypatch):
    monkeypatch.setattr(explore, "PRINTED_CHARACTERS", 100)
    out = explore.query_status(spark, "SELECT id, repeat('x', 40) AS wide FROM range(5)")
    assert out.note == "1 of 5 rows" and out.rows.count() == 5
    out = explore.query_status(spark, "SELECT repeat('x', 400) AS wide")
    assert out.note == "" and "xxx" in out.text


def test_discard_and_errors(spark):
    out = explore.query_status(spark, "SELECT 1 AS one")
    assert path_exists(spark, out.path)
    out.discard()
    assert not path_exists(spark, out.path)
    failed = explore.query_status(spark, "SELECT raise_error('late') FROM range(3)")
    assert failed.status == "error" and "late" in failed.text and failed.rows is None
    assert explore.query_status(spark, "CREATE OR REPLACE TEMP VIEW made_by_query AS SELECT 1 AS one").status == "empty"
    assert spark.table("made_by_query").select(F.col("one")).count() == 1
