"""Search that skips files against search that reads them all."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from rosterline.operators.explore import search_any
from rosterline.sources import catalog, search_index
from tests.conftest import rows


@pytest.mark.parametrize(
    "pattern, literals",
    [
        ("abc", ["abc"]), ("abc|def", []), ("ab+cd", ["ab", "cd"]), ("abc?d", ["ab", "d"]), ("(rely|hine?) th(at|e) [a-z]+tion", [" th", " ", "tion"]),
        (r"a\.b\d+c", ["a.b", "c"]), (r"\Qa|b\E", []), ("a{2}bc", ["bc"]), ("[a|b]cde", ["cde"]), ("(?x)a b", []), ("ABC.d", ["abc", "d"]),
        ("x(a(b)c)*yz", ["x", "yz"]), (r"\x41bc", []), ("ab*?c", ["a", "c"]), ("(ab", []), ("", []), ("^abc$", ["abc"]), ("a+?bc", ["a", "bc"]),
    ],
)
def test_required_literals(pattern, literals):
    assert search_index.required_literals(pattern) == literals


def test_every_match_holds_the_literals():
    draw, seen = random.Random(6), 0
    atoms = ["a", "b", "B", ".", "[ab]", "(a|b)", "(ab)", "a?", "b*", "a+", "a{2}", "(?:b)?", r"\.", r"\w", "^", "$", "c{0,1}", "|"]
    for _ in range(4000):
        pattern = "".join(draw.choice(atoms) for _ in range(draw.randrange(1, 7)))
        text = "".join(draw.choice("aAbB.c") for _ in range(draw.randrange(9)))
        if re.search(pattern, text, re.I):
            seen += 1
            assert all(each in text.lower() for each in search_index.required_literals(pattern)), (pattern, text)
    assert seen > 1000


def files_read(df):
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), 0
    leaves = (plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan).collectLeaves()
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numFiles")
        out += metric.get().value() if metric.isDefined() else 0
    return out


@pytest.fixture
def stored(spark, database):
    name = f"{database}.t"
    text = F.when(F.col("id") == 77, "the Needle, here").when(F.col("id") == 5, None).otherwise(F.concat(F.lit("plain row "), F.col("id")))
    catalog.replace_table(spark, name, spark.range(0, 200, 1, 10).select("id", text.alias("some text"), F.lit("needles in another column").alias("z")).withColumn("z", F.when(F.col("id") > 190, F.col("z"))))
    search_index.build_search_index(spark, name)
    return name


def test_files_are_skipped_and_rows_are_the_same(spark, stored):
    table = catalog.read_table(spark, stored)
    for pattern in ("needle,", "NEEDLE", "need(le|x)s? in", "row 1[0-9]9", "no such text", "^77$", "needles.*column", "pl.in", "a|b"):
        assert rows(search_index.search_stored(spark, stored, pattern)) == rows(search_any(table, pattern)), pattern
    assert files_read(search_index.search_stored(spark, stored, "needle,")) == 1
    assert files_read(search_index.search_stored(spark, stored, "needle")) == 2
    assert files_read(search_index.search_stored(spark, stored, "no such text")) == 0
    assert files_read(search_index.search_stored(spark, stored, "pl.in")) == 10
    assert search_index.search_stored(spark, stored, None).count() == 200


def test_an_index_belongs_to_its_version(spark, stored, database):
    catalog.replace_table(spark, stored, catalog.read_table(spark, stored).withColumn("z", F.lit("needle,")))
    assert search_index.search_stored(spark, stored, "needle,").count() == 200  # not indexed yet: all is read
    search_index.build_search_index(spark, stored)

    def kept():
        return [t.name for t in spark.catalog.listTables(f"{database}__versions") if not t.isTemporary]

    assert len([name for name in kept() if name.endswith("__trigrams")]) == 2
    catalog.sweep_versions(spark, database, dt.timedelta(0))
    assert len(kept()) == 2
    assert catalog.drop_relation(spark, stored) == "table"
    assert not kept()
