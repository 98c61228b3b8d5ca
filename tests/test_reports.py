"""Report invariants, both forms, and edge rows under the headers users upload."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rosterline.operators.grain import GRAIN_4, GRAIN_5, spine, to_grain
from rosterline.plans import reports
from rosterline.plans.facts import CURRENT, DEMAND, PREVIOUS
from rosterline.plans.rollup import pdl_rollup
from tests.conftest import SMALL, rows
from verification.fixtures import report_tables

HEADCOUNT = (
    "`Project Id` string, Practice string, `Utilization Location` string, `Grade Name` string, `HCM Department Name` string, "
    "`HCM Department ID` string, `Associate ID` string, `Billed FTE Internal` string, `Total FTE` string, BU string, "
    "`Customer Id` string, `Project Name` string, `Project Type` string, `Project Billability` string, `Customer Name` string, "
    "ParentCustomerID string, `Parent Customer` string, `Is Onsite` string"
)
DEMANDS = (
    "`Project Id` string, practice string, Location string, `Grade HR` string, `Pool Name` string, BU string, "
    "`Account ID` string, `Project Description` string, `Project Type` string, `Project Billability` string, "
    "`Account Name` string, `Parent Customer ID` string, `Parent Customer` string"
)
FLOW = "`Project Id` string, Practice string, Location string, {grade} string, {dept} string, {fte} string"
ALL = [
    reports.report_v1, reports.report_v2, reports.report_v3, reports.report_v4, reports.report_grain4_d2,
    reports.report_grain4_d8, reports.report_grain5_d13, reports.report_grain5_d15,
]


def person(project, dept="Cloud", billed="1", total="1", associate="A1", bu="B1", account="C1", grade="G1"):
    return (
        project, "Data", "Pune", grade, dept, dept and f"id-{dept}", associate, billed, total, bu, account, f"name {project}", "T&M",
        "BL", "Customer", "P1", "Parent", "No",
    )


def demand(project, dept="Cloud", account="C9", bu="B1"):
    return (project, "Data", "Pune", "G1", dept, bu, account, f"demand {project}", "Fixed", "BL", "Account", "P9", "Parent 9")


@pytest.fixture
def tables(spark):
    def frame(data, schema):
        return spark.createDataFrame(data, schema)

    def flow(data, grade, dept, fte):
        return frame(data, FLOW.format(grade=grade, dept=dept, fte=fte))

    key = ("one", "Data", "Pune", "G1", "Cloud")
    releases = flow([(*key, "0.5"), ("nowhere", "Data", "Pune", "G1", "Cloud", "9")], "Grade", "`Department Name`", "`Impact FTE`")
    return {
        "utilization_prediction_report": frame(
            [person("one"), person("one", billed="bad", associate=None), person("nodept", dept=None), person("bad", billed="x")],
            HEADCOUNT,
        ),
        "previous_month_actual": frame(
            [person("one", billed="2", total="3"), person("closed", billed="4", total="4"), person("bad", billed="x", total=None),
             person("nodept", dept=None, billed="7", total="7")],
            HEADCOUNT,
        ),
        "demand_base": frame([demand("one"), demand("one"), demand("wanted", account="C1")], DEMANDS),
        "fulfilment": flow([(*key, "1"), (*key, "1.5")], "`Associate Hired Grade`", "`Pool Name`", "`FTE Impact`"),
        "releases": releases,
        "np_jan26": releases,
        "attrition": flow([(*key, "0.25")], "Grade", "`Department Name`", "`FTE Impact`"),
        "map_location": frame([("Pune", "India", "East")], "`Utilization Location` string, Country string, Geo string"),
        "map_bu": frame([("B1", "S1", "M1")], "BU string, SBU string, Market string"),
        "map_sbu": frame([("S1", "7", "Head")], "SBU string, `SBU Head ID` string, `SBU Head Name` string"),
        "map_account": frame(
            [("C1", "L1", "Lead"), ("C1", "L1", None), ("C9", "L9", "Other")], "`Account ID` string, `PDL ID` string, `PDL Name` string"
        ),
        "map_tower": frame([("id-Cloud", "Tower C")], "`Department ID` string, Tower string"),
        "map_grade": frame([("G1", "CoD 1")], "Grade string, `CoD Grade` string"),
        "cost_file": frame([("Data", "India", "G1", "10")], "Practice string, Country string, `Grade name` string, Cost string"),
    }


def by_project(df):
    return {row["Project Id"]: row.asDict() for row in df.collect()}


@pytest.mark.parametrize("report", ALL, ids=lambda report: report.__name__)
def test_both_forms_agree(spark, tables, report):
    for given in (tables, report_tables(spark, SMALL)):
        one, joined = report(given), report(given, form="joined")
        assert one.dtypes == joined.dtypes
        assert rows(one) == rows(joined)


def test_headline_values(tables):
    found = by_project(reports.report_grain5_d15(tables))
    assert set(found) == {"one", "nodept", "bad", "closed", "wanted"}  # "nowhere" only left, and is lost
    one = found["one"]
    assert (one["release_count"], one["attr_count"], one["open_demands"], one["demands_fulfilled"]) == (0.5, 0.25, 2, 2.5)
    assert one["eff_billed_fte"] == pytest.approx(2 + 0.5 * 2.5 + 0.2 * 2 - 0.25 - 0.5)
    assert one["eff_total_fte"] == pytest.approx(3 + 2.5 + 0.5 * 2 - 0.25 - 0.5)
    assert (one["std_cost"], one["prev_billed_cost"], one["proj_billed_cost"]) == (10.0, 20.0, 29.0)
    assert (one["project_name"], one["department_id"], one["Tower"]) == ("name one", "id-Cloud", "Tower C")
    assert (one["PDL Name"], one["SBU Head Name"], one["Country"]) == ("Lead", "Head", "India")


def test_null_key_keeps_row_without_values(tables):
    row = by_project(reports.report_grain5_d15(tables))["nodept"]
    assert row["prev_mon_billed_fte"] == 0 and row["project_name"] is None and row["BU"] is None
    assert row["Country"] == "India" and row["std_cost"] == 10.0  # lookups on the key itself still match


def test_all_bad_numbers_count_as_zero(tables):
    row = by_project(reports.report_grain5_d15(tables))["bad"]
    assert row["prev_mon_billed_fte"] == 0 and row["prev_mon_total_fte"] == 0


def test_demand_only_project_has_customer_but_no_lead(tables):
    row = by_project(reports.report_grain5_d15(tables))["wanted"]
    assert row["customer_id"] == "C1" and row["PDL Name"] is None
    assert row["BU"] == "B1" and row["SBU"] == "S1"
    assert by_project(reports.report_grain5_d13(tables))["wanted"]["BU"] is None


def test_missing_cost_and_strict_cost(spark, tables):
    no_cost = {**tables, "cost_file": tables["cost_file"].filter("Cost = '0'")}
    row = by_project(reports.report_grain5_d15(no_cost))["one"]
    assert row["std_cost"] is None and row["proj_total_cost"] is None and row["eff_total_fte"] is not None
    bad_cost = {**tables, "cost_file": tables["cost_file"].withColumn("Cost", F.lit("ten"))}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        reports.report_grain5_d15(bad_cost).collect()


def test_closed_projects(tables):
    v4 = by_project(reports.report_v4(tables, dt.date(2025, 1, 31)))
    assert set(v4) == {"one", "nodept", "bad", "closed"}
    closed = v4["closed"]
    assert closed["project_name"] == "Closed Project" and closed["billed_fte"] == 0
    assert closed["prev_mon_actual_billed_fte"] == 4 and closed["eff_billed_fte"] is None
    assert closed["Country"] is None and closed["prediction_date"] is None
    assert by_project(reports.report_grain4_d2(tables))["closed"]["Country"] == "India"


def test_account_duplicates_inflate_version_1_only(tables):
    def total(df):
        return df.agg(F.sum("total_billed_fte")).head()[0]

    v1, v2 = reports.report_v1(tables), reports.report_v2(tables)
    assert v1.count() > v2.count()
    assert total(v1) > total(v2) == 2.0


def test_lookup_duplicates_multiply_rows(tables):
    twice = {**tables, "map_bu": tables["map_bu"].union(tables["map_bu"])}
    assert reports.report_grain5_d15(twice).count() > reports.report_grain5_d15(tables).count()


@pytest.mark.parametrize("grain, report", [(GRAIN_4, reports.report_grain4_d8), (GRAIN_5, reports.report_grain5_d15)])
def test_as_many_rows_as_keys(spark, grain, report):
    given = report_tables(spark, SMALL)
    keys = spine([to_grain(given[source.table], source, grain) for source in (CURRENT, PREVIOUS, DEMAND)], grain)
    assert report(given).count() == keys.count()


def test_weights(tables):
    same = reports.report_grain5_d15(tables, reports.Weights(0.5, 0.2, 1.0, 0.5))
    assert rows(same) == rows(reports.report_grain5_d15(tables))
    other = by_project(reports.report_grain5_d15(tables, reports.Weights(0.0, 1.0, 0.0, 0.0)))["one"]
    assert other["eff_billed_fte"] == pytest.approx(2 + 2 - 0.75)
    assert other["eff_total_fte"] == pytest.approx(3 - 0.75)


def test_rollup_divides_by_rounded_fte(spark):
    data = [
        ("L", "P", "Data", "T", "G", 0.4, 100.0, 50.0),
        ("L", "Q", "Data", "T", "G", 2.5, 30.0, 45.0),
        (None, "P", "Data", None, "G", -0.3, 1.0, 1.0),
        ("L", None, "Data", None, "G", 1.0, 1.0, None),
    ]
    report = spark.createDataFrame(
        data,
        "`PDL Name` string, parent_customer_name string, Practice string, project_type string, Grade string, "
        "prev_mon_actual_billed_fte double, prev_total_cost double, proj_total_cost double",
    )
    found = [tuple(row) for row in pdl_rollup(report, dt.datetime(2025, 1, 31, 20)).collect()]
    assert [row[:2] for row in found] == [("L", "P"), ("L", "Q"), ("L", None), (None, "P")]  # NULLs last
    assert found[0][5:9] == (0.0, None, None, None)
    assert found[1][5:9] == (3.0, 10.0, 15.0, 5.0)
    assert str(found[3][5]) == "0.0"
    assert found[0][9] == "2025-02-01 01:30:00"


def test_hot_key_and_nulls(spark, tables):
    """A third of the rows on one key, and as many on a NULL account."""
    columns = tables["previous_month_actual"].columns

    def people(of):
        return spark.range(30_000).select("id", *[F.lit(value).cast("string").alias(name) for name, value in zip(columns, of)])

    crowd = people(person("hot")).drop("id")
    many = people(person("any", account=None)).withColumn("Project Id", F.col("id").cast("string")).drop("id")
    given = {**tables, "previous_month_actual": crowd.unionByName(many)}
    one = reports.report_grain5_d15(given)
    hot = by_project(one.filter("`Project Id` = 'hot'"))["hot"]
    assert hot["prev_mon_billed_fte"] == 30_000
    assert one.count() == 30_000 + 5  # and hot, one, null, bad, wanted


@pytest.mark.parametrize("seed", [1, 2])
def test_both_forms_agree_on_random_facts(spark, tables, seed):
    """Few keys, many NULLs in keys, descriptions and numbers, and every source with keys of its own."""
    draw = random.Random(seed)

    def cell(name):
        if draw.random() < 0.15:
            return None
        if "FTE" in name:
            return draw.choice(["1", "2.5", "x", "0", "-1", ""])
        return f"{name[:3]}{draw.randrange(3)}"

    def facts(df, count=150):
        return spark.createDataFrame([tuple(cell(name) for name in df.columns) for _ in range(count)], df.schema)

    names = ("utilization_prediction_report", "previous_month_actual", "demand_base", "fulfilment", "releases", "attrition", "np_jan26")
    given = {**tables, **{name: facts(tables[name], 40 if name == "demand_base" else 150) for name in names}}
    for report in ALL:
        assert rows(report(given)) == rows(report(given, form="joined")), report.__name__
