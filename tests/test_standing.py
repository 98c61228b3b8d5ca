"""Standing views and stored parts against the reports themselves."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from rosterline.functions import to_number
from rosterline.operators.grain import GRAIN_4
from rosterline.plans import parts, reports, standing
from rosterline.plans.rollup import pdl_rollup
from rosterline.sources import catalog
from rosterline.sources.ingest import replace_validated
from tests.conftest import SMALL, rows
from tests.test_plans import plan_of
from verification.fixtures import report_tables
from verification.registry import LOADED_AT, OTHER_WEIGHTS


def spaced(df):
    """The headers as users write them."""
    words = {"id": "Id", "fte": "FTE", "bu": "BU", "hcm": "HCM"}
    return df.toDF(*[" ".join(words.get(word, word.title()) for word in name.split("_")) for name in df.columns])


@pytest.fixture(scope="module")
def tables(spark):
    return {name: spaced(df) if name in parts.FACTS else df for name, df in report_tables(spark, SMALL).items()}


@pytest.fixture
def stored(spark, database, tables):
    for name, df in tables.items():
        catalog.replace_table(spark, f"{database}.{name}", df)
    return database


def test_numbers_in_text(spark):
    texts = ["1", " 2 ", "1_000", "1__0", "1_", "1.5d", "1f", "inf", "-INF", "nan", "1,0", "", None, "x", ".5", "1e3", "1D\t", "infd", "_1"]
    df = spark.createDataFrame([(t,) for t in texts], "`a b` string")
    out = df.select(to_number(F.col("`a b`")).cast("string").alias("x"), F.expr(f"CAST({standing.number_text('`a b`')} AS STRING)").alias("y"))
    assert [row["x"] for row in out.collect()] == [row["y"] for row in out.collect()]


def test_views_show_the_reports(spark, stored, tables):
    standing.create_report_views(spark, stored, OTHER_WEIGHTS, at=LOADED_AT)
    view = lambda name: catalog.read_table(spark, f"{stored}.{name}")
    assert view("dashboard15").columns == reports.report_grain5_d15(tables).columns
    assert rows(view("dashboard15")) == rows(reports.report_grain5_d15(tables, OTHER_WEIGHTS))
    grain4 = reports.report_grain4_d8(tables)
    assert view("dashboard8").dtypes == grain4.dtypes and rows(view("dashboard8")) == rows(grain4)
    assert [tuple(r) for r in view("pdl_summary").collect()] == [tuple(r) for r in pdl_rollup(grain4, LOADED_AT).collect()]
    kinds = {row["table"]: row["kind"] for row in catalog.list_tables(spark, stored).collect()}
    assert {kinds[name] for name in ("dashboard15", "dashboard8", "pdl_summary")} == {"view"} and kinds["fulfilment"] == "table"


def test_views_follow_uploads_with_more_columns(spark, stored, tables):
    standing.create_report_views(spark, stored)
    before = rows(catalog.read_table(spark, f"{stored}.dashboard15"))
    new = tables["fulfilment"].withColumn("Remark", F.lit("x")).withColumn("FTE Impact", F.lit("3"))
    replace_validated(spark, f"{stored}.fulfilment", new)
    after = rows(catalog.read_table(spark, f"{stored}.dashboard15"))
    assert after != before and after == rows(reports.report_grain5_d15({**tables, "fulfilment": new}))


def test_views_keep_null_keys_and_have_one_exchange_of_facts(spark, stored):
    standing.create_report_views(spark, stored)
    df = catalog.read_table(spark, f"{stored}.dashboard15")
    assert df.filter("department_name IS NULL").count() > 0
    plan = plan_of(df)
    facts = plan[plan.index("Union"):]
    assert facts[: facts.index("BroadcastExchange")].count("FileScan") == 6
    assert len(re.findall("Exchange hashpartitioning", plan)) == 3  # facts, departments, accounts


@pytest.fixture
def in_parts(spark, database, tables):
    parts.refresh_parts(spark, database, {name: tables[name] for name in parts.FACTS}, 4)
    return {**tables, **parts.part_tables(spark, database)}


@pytest.mark.parametrize(
    "report", [reports.report_v1, reports.report_v2, reports.report_v3, reports.report_v4, reports.report_grain4_d2,
               reports.report_grain4_d8, reports.report_grain5_d13, reports.report_grain5_d15], ids=lambda each: each.__name__,
)
def test_reports_from_parts(tables, in_parts, report):
    merged = report(in_parts)
    assert merged.columns == report(tables).columns and rows(merged) == rows(report(tables))


def test_parts_are_merged_without_an_exchange_and_read_no_fact(spark, in_parts):
    for report in (reports.report_grain5_d15, reports.report_grain4_d8):
        plan = plan_of(report(in_parts))
        assert not re.findall(r"Exchange hashpartitioning\([^)]*__key_hash", plan)
        assert not re.search(r"Exchange hashpartitioning\([^)]*Project Id", plan)
        assert "Scan parquet" not in plan.replace("FileScan parquet", "") and "role" not in plan.replace("Role", "")
        assert len(re.findall(r"Bucketed: true", plan)) >= 6


def test_a_refresh_reads_one_fact(spark, database, tables, in_parts):
    new = tables["releases"].withColumn("Impact FTE", F.lit("2"))
    part = parts.part_of(new, parts.FACTS["releases"])
    assert plan_of(part).count("FileScan") == 1
    parts.refresh_parts(spark, database, {"releases": new}, 4)
    merged = reports.report_grain5_d15({**tables, **parts.part_tables(spark, database)})
    assert rows(merged) == rows(reports.report_grain5_d15({**tables, "releases": new}))


def test_parts_and_facts_do_not_mix(tables, in_parts):
    with pytest.raises(ValueError, match="or none"):
        reports.report_grain4_d8({**in_parts, "fulfilment": tables["fulfilment"]}).count()


def test_empty_fact(spark, database, tables):
    none = {name: df.limit(0) for name, df in tables.items() if name in parts.FACTS}
    parts.refresh_parts(spark, database, none, 2)
    assert reports.report_grain5_d15({**tables, **parts.part_tables(spark, database)}).count() == 0
    assert [c for c in parts.part_tables(spark, database)["demand_base"].columns if c in GRAIN_4] == list(GRAIN_4)
