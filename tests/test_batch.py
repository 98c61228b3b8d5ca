"""Many uploads at once."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from rosterline.sources import catalog, ingest
from tests.conftest import rows
from tests.test_sources import AT, STAMP

BODIES = {
    "Plain One": "Id,Name\n1,x\n2,\n",
    "Plain Two": "Id,Name\r\n3,\"a,\r\nb\"\r\n",
    "wide": "a,b, a ,,load_date\n1,2,3,4,5\n6\n",
    "Odd Name %41+é": "x\nNA\ny\n",
    "no rows": "p,q\n",
    "too many": "p,q\n1,2,3\n",
    "too many quoted": 'p,q,r,s,t,u\n1,2,3,4,5,6,""\n',
    "blank extras": "p,q\n1,2,,,\n3,4\n",
    "case": "A,a\n1,2\n",
    "header break": '"a\nb",c\n1,2\n',
    "nothing": "",
}


@pytest.fixture
def uploads(tmp_path):
    paths = []
    for name, body in BODIES.items():
        path = tmp_path / f"{name}.csv"
        path.write_bytes(body.encode())
        paths.append(str(path))
    return paths


def jobs_of(spark, action):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_same_tables_as_one_by_one(spark, database, uploads):
    status = {r["path"]: r for r in ingest.ingest_batch(spark, uploads, database, AT).collect()}
    for path in uploads:
        table = status[path]["table"]
        try:
            alone = ingest.ingest_text(spark, path, f"{database}.alone", AT)
            want = rows(alone)
        except Exception:
            assert status[path]["status"] == "failed" and status[path]["error"], path
            assert not spark.catalog.tableExists(f"{database}.`{table}`")
            continue
        if status[path]["status"] == "failed":
            assert "not a valid name" in status[path]["error"]
            continue
        loaded = catalog.read_table(spark, f"{database}.`{table}`")
        assert loaded.dtypes == alone.dtypes and rows(loaded) == want, path
        assert status[path]["rows"] == len(want)
    found = {path.rsplit("/", 1)[-1]: status[path]["status"] for path in uploads}
    assert [name for name, state in found.items() if state == "complete"] == [
        "Plain One.csv", "Plain Two.csv", "wide.csv", "no rows.csv", "blank extras.csv", "header break.csv",
    ]


def test_jobs_do_not_grow_with_the_files(spark, database, tmp_path):
    def load(n):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            (folder / f"t{i}.csv").write_text(f"h{i % 3},k\n{i},z\n")
        return jobs_of(spark, lambda: ingest.ingest_batch(spark, [str(folder / f"t{i}.csv") for i in range(n)], database, AT).collect())

    assert load(120) == load(40) < 20
    assert rows(catalog.read_table(spark, f"{database}.t119")) == [("119", "z", STAMP)]


def test_tables_loaded_together_are_tables(spark, database, uploads):
    ingest.ingest_batch(spark, uploads[:3], database, AT)
    assert ("plain_one", "table") in rows(catalog.list_tables(spark, database))
    plan = catalog.read_table(spark, f"{database}.wide").select("b")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__file" in plan and "ReadSchema: struct<_1:string>" in plan
    before = catalog.read_table(spark, f"{database}.plain_one")
    ingest.replace_validated(spark, f"{database}.plain_one", before.withColumn("Id", F.lit("9")), AT)
    assert rows(before) == [("1", "x", STAMP), ("2", None, STAMP)]
    assert rows(catalog.read_table(spark, f"{database}.plain_one")) == [("9", "x", STAMP), ("9", None, STAMP)]
    assert catalog.drop_relation(spark, f"{database}.plain_two") == "table"
    assert catalog.sweep_versions(spark, database, dt.timedelta(0)) == []  # one table still reads the common version
    catalog.drop_relation(spark, f"{database}.wide")
    assert len(catalog.sweep_versions(spark, database, dt.timedelta(0))) == 1


def test_last_file_of_a_table_wins(spark, database, tmp_path):
    for folder, body in (("x", "a\n1\n"), ("y", "b\n2\n3\n"), ("z", "b\n4,5\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "t.csv").write_text(body)
    status = ingest.ingest_batch(spark, [str(tmp_path / folder / "t.csv") for folder in "xyz"], database, AT).collect()
    assert [row["status"] for row in status] == ["replaced", "complete", "failed"]
    assert rows(catalog.read_table(spark, f"{database}.t")) == [("2", STAMP), ("3", STAMP)]


def test_a_view_is_not_replaced(spark, database, tmp_path):
    catalog.replace_view(spark, f"{database}.t", "SELECT 1 AS one")
    (tmp_path / "t.csv").write_text("a\n1\n")
    row = ingest.ingest_batch(spark, [str(tmp_path / "t.csv")], database, AT).first()
    assert row["status"] == "failed" and "is a view" in row["error"]
