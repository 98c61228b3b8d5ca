from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from rosterline.functions import (
    any_matches, any_non_null, avg_text, contains_ci, ist_text, label_missing, per_unit, prediction_date_text, round5,
    sum_text, table_name_expr, to_number, whole,
)
from rosterline.functions.numbers import nearest
from tests.test_plans import plan_of


def one(spark, schema, values, expression):
    df = spark.createDataFrame([(value,) for value in values], schema)
    return [row[0] for row in df.select(expression).collect()]


NUMBERS = {
    "12": 12.0, " 12 ": 12.0, "-1.5e2": -150.0, ".5": 0.5, "inf": math.inf, "1,000": None, "": None, "n/a": None, None: None,
    "1_000": 1000.0, "1__0": None, "_1": None, "1.0d": None, "1f ": None, "2F": None, "0x10": None,
}


def test_to_number(spark):
    assert one(spark, "v string", list(NUMBERS), to_number(F.col("v"))) == list(NUMBERS.values())


def test_text_aggregates(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("a", "3"), ("b", "x"), ("b", None)], "k string, v string")
    found = df.groupBy("k").agg(sum_text(F.col("v")), avg_text(F.col("v")), any_non_null(F.col("v"))).orderBy("k").collect()
    assert [tuple(row) for row in found] == [("a", 4.0, 2.0, "1"), ("b", None, None, "x")]


def test_rounding(spark):
    assert one(spark, "v double", [2.5, -2.5, -0.3, None], whole(F.col("v"))) == [3.0, -3.0, 0.0, None]
    assert one(spark, "v double", [1262.293125, 1402.853125, 0.1 + 0.2, None], round5(F.col("v"))) == [
        1262.29312, 1402.85313, 0.3, None,
    ]


def test_per_unit_without_units(spark):
    df = spark.createDataFrame([(10.0, 4.0), (10.0, 0.0), (None, 2.0)], "total double, units double")
    assert [row[0] for row in df.select(per_unit(F.col("total"), F.col("units"))).collect()] == [3.0, None, None]


def test_ist(spark):
    found = one(spark, "v timestamp_ntz", [dt.datetime(2024, 12, 31, 18, 30)], ist_text(F.col("v"), " IST", F.lit("UTC")))
    assert found == ["2025-01-01 00:00:00 IST"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_ist_does_not_depend_on_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        now, fixed = spark.range(1).select(
            ist_text(), ist_text(F.timestamp_seconds(F.lit(1_735_669_800)))
        ).head()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert fixed == "2025-01-01 00:00:00"
    expected = dt.datetime.now(dt.timezone.utc) + dt.timedelta(hours=5, minutes=30)
    assert abs(dt.datetime.fromisoformat(now) - expected.replace(tzinfo=None)) < dt.timedelta(minutes=2)


def test_prediction_date_text(spark):
    assert spark.range(1).select(prediction_date_text(dt.date(2025, 1, 31))).head()[0] == "2025-01-31"


def test_predicates(spark):
    values = ["Alpha beta", "ALPHA", None, "gamma"]
    assert one(spark, "v string", values, contains_ci(F.col("v"), "alph")) == [True, True, None, False]
    assert one(spark, "v string", values, any_matches([F.col("v")], "^alpha$|none|nan")) == [False, True, False, False]
    assert one(spark, "v string", [None, "a"], label_missing(F.col("v"), "Closed Project")) == ["Closed Project", "a"]


def plain_table_name(file_name: str) -> str:
    name = file_name.lower()
    for suffix in (".xlsx", ".xlsb"):
        name = "".join(name.split(suffix))
    return "_".join(name.split(" ")).strip()


EDGES = ["Plan 2025.XLSX", " a b.xlsx", "x.xlsxb", "x.xls.xlsxx", "\ta.xlsb\n", "a.xlsb.xlsx.b", "no suffix", " pad .xlsx"]


def test_table_names(spark):
    assert one(spark, "v string", EDGES, table_name_expr(F.col("v"))) == [plain_table_name(name) for name in EDGES]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB. xlsb\t\n", max_size=20), min_size=20, max_size=40))
def test_table_names_at_random(spark, names):
    assert one(spark, "v string", names, table_name_expr(F.col("v"))) == [plain_table_name(name) for name in names]


def test_round5_takes_no_decimals_and_rounds_as_round_does(spark):
    draw, halves = random.Random(5), [k + 0.5 for k in range(-9, 9)]
    around = [math.nextafter(half, to) for half in halves for to in (-math.inf, math.inf)]
    large = [sign * (2.0**power + step) for sign in (1, -1) for power in (51, 52, 53, 70, 1000) for step in (-1, -0.5, 0, 0.5, 1)]
    odd = [None, 0.0, -0.0, -0.3, 5e-324, math.nan, math.inf, -math.inf, 1.7976931348623157e308]
    drawn = [draw.uniform(-(10.0**power), 10.0**power) for power in range(-8, 18) for _ in range(200)]
    values = spark.createDataFrame([(each,) for each in [*halves, *around, *large, *odd, *drawn]], "x double")
    x = F.col("x").cast("double")
    got = values.select("x", nearest(x).alias("a"), F.round(x).alias("b"), round5(x).alias("c"), (F.round(x * 100000.0) / 100000.0).alias("d"))
    assert all(repr(row.a) == repr(row.b) and repr(row.c) == repr(row.d) for row in got.collect())
    assert "round(" not in plan_of(values.select(round5(x)))
