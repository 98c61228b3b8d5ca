"""Loading keeps every cell, or fails the file."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rosterline.functions import ist_text
from rosterline.operators.headers import number_repeats
from rosterline.sources.ingest import read_text


def _file(tmp_path, text):
    path = tmp_path / "rows.csv"
    path.write_text(text)
    return f"file://{path}"


def test_repeated_headers_are_numbered(spark, tmp_path):
    df = read_text(spark, _file(tmp_path, 'a,a,b\n1,2,3\n4,5\n"6\n6",7,8\n'))
    assert df.columns == ["a", "a.1", "b"]
    assert sorted(tuple(row) for row in df.collect()) == [("1", "2", "3"), ("4", "5", None), ("6\n6", "7", "8")]
    assert number_repeats(["a", "a.1", "a"]) == ["a", "a.1", "a.2"]


def test_wide_rows_fail_the_file(spark, tmp_path):
    with pytest.raises(Exception, match="more cells than headers"):
        read_text(spark, _file(tmp_path, "a,b\n1,2\n1,2,3\n")).collect()


def test_clock_in_the_repeated_hour(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for minute, want in ((5, "11:00:00"), (6, "12:00:00")):
            at = int(dt.datetime(2025, 11, 2, minute, 30, tzinfo=dt.timezone.utc).timestamp())
            text = spark.range(1).select(ist_text(F.timestamp_seconds(F.lit(at)))).first()[0]
            assert text == f"2025-11-02 {want}"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_filled_cell_far_beyond_the_header(spark, tmp_path):
    def load(row):
        path = tmp_path / "wide.csv"
        path.write_text(f'a,b\n1,2\n{row}\n"x,",3\n')
        return sorted(tuple(each) for each in read_text(spark, f"file://{path}").collect())

    for row in ("4,5" + "," * 17 + "lost", "4,5" + "," * 40 + '"far, out"' + ",,", "4,5,6"):
        with pytest.raises(Exception, match="more cells than headers"):
            load(row)
    assert load('"4,",5' + "," * 30) == [("1", "2"), ("4,", "5"), ("x,", "3")]
    assert load("4") == [("1", "2"), ("4", None), ("x,", "3")]
