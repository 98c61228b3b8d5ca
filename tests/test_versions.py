"""Tables as names that point to versions."""

from __future__ import annotations

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from rosterline.sources import catalog
from rosterline.sources.ingest import replace_validated
from tests.conftest import rows

NOW = dt.timedelta(0)


def versions(spark, database):
    return [t.name for t in spark.catalog.listTables(f"{database}__versions") if not t.isTemporary]


def test_a_frame_read_before_the_swap_finishes(spark, database):
    name = f"{database}.t"
    before = catalog.replace_table(spark, name, spark.range(5))
    catalog.replace_table(spark, name, spark.range(9).select("id", F.lit("x").alias("more")))
    catalog.replace_table(spark, name, spark.range(2).select(F.col("id").cast("string").alias("other")))
    assert before.count() == 5 and rows(before.agg(F.sum("id"))) == [(10,)]
    assert rows(catalog.read_table(spark, name)) == [("0",), ("1",)]
    assert len(versions(spark, database)) == 3
    assert len(catalog.sweep_versions(spark, database, NOW)) == 2
    assert len(versions(spark, database)) == 1 and catalog.read_table(spark, name).count() == 2


def test_no_moment_without_a_table(spark, database):
    name, failed, stop = f"{database}.t", [], threading.Event()
    catalog.replace_table(spark, name, spark.range(3))

    def read():
        while not stop.is_set():
            try:
                assert catalog.read_table(spark, name).count() == 3
            except Exception as error:
                failed.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for _ in range(6):
            catalog.replace_table(spark, name, spark.range(3))
    finally:
        stop.set()
        reader.join()
    assert not failed


def test_a_failed_swap_leaves_no_trace(spark, database, monkeypatch):
    name = f"{database}.t"
    catalog.replace_table(spark, name, spark.range(3))
    original = type(spark).sql

    def broken(self, text, *args, **named):
        if text.startswith("CREATE OR REPLACE VIEW"):
            raise RuntimeError("no catalog")
        return original(self, text, *args, **named)

    monkeypatch.setattr(type(spark), "sql", broken)
    with pytest.raises(RuntimeError):
        catalog.replace_table(spark, name, spark.range(4))
    monkeypatch.undo()
    assert catalog.read_table(spark, name).count() == 3 and len(versions(spark, database)) == 1


def test_old_versions_go_when_out_of_use_long_enough(spark, database):
    name = f"{database}.t"
    for n in range(3):
        catalog.replace_table(spark, name, spark.range(n))
    assert catalog.sweep_versions(spark, database) == []
    catalog.replace_table(spark, name, spark.range(7), keep=NOW)
    assert len(versions(spark, database)) == 1 and catalog.read_table(spark, name).count() == 7


def test_sweep_spares_other_tables_and_takes_orphans(spark, database):
    catalog.replace_table(spark, f"{database}.t", spark.range(3))
    catalog.replace_table(spark, f"{database}.t__v1", spark.range(4))
    spark.sql(f"DROP VIEW {database}.t")
    gone = catalog.sweep_versions(spark, database, NOW)
    assert len(gone) == 1 and gone[0].startswith("t__v2")
    assert catalog.read_table(spark, f"{database}.t__v1").count() == 4


def test_a_plain_table_is_taken_over(spark, database):
    name = f"{database}.plain"
    spark.range(3).write.saveAsTable(name)
    assert rows(catalog.list_tables(spark, database)) == [("plain", "table")]
    old = spark.table(name)
    catalog.replace_table(spark, name, old.withColumn("twice", F.col("id") * 2))
    assert rows(spark.table(name)) == [(0, 0), (1, 2), (2, 4)]
    assert rows(catalog.list_tables(spark, database)) == [("plain", "table")]
    assert [t.name for t in spark.catalog.listTables(database) if not t.isTemporary] == ["plain"]


def test_kinds(spark, database):
    catalog.replace_table(spark, f"{database}.T", spark.range(3))
    catalog.replace_view(spark, f"{database}.v", f"SELECT COUNT(*) AS n FROM {database}.t")
    assert rows(catalog.list_tables(spark, database)) == [("t", "table"), ("v", "view")]
    assert set(catalog.catalog_tables(spark, database)) == {"t"}
    with pytest.raises(ValueError, match="is a table"):
        catalog.replace_view(spark, f"{database}.t", "SELECT 1 AS one")
    with pytest.raises(ValueError, match="is a view"):
        catalog.replace_table(spark, f"{database}.v", spark.range(1))
    assert catalog.drop_relation(spark, f"{database}.t") == "table"
    assert versions(spark, database) == [] and rows(catalog.list_tables(spark, database)) == [("v", "view")]


def test_a_view_follows_its_table(spark, database):
    catalog.replace_table(spark, f"{database}.t", spark.createDataFrame([("1", "old")], "n string, load_date string"))
    view = catalog.replace_view(spark, f"{database}.v", f"SELECT n FROM {database}.t")
    assert rows(view) == [("1",)]
    replace_validated(spark, f"{database}.t", spark.createDataFrame([("2", "x"), ("3", "y")], "n string, extra string"))
    assert rows(catalog.read_table(spark, f"{database}.v")) == [("2",), ("3",)]
