"""Physical plans: what would not survive a thousand times the data."""

from __future__ import annotations

import re

import pyarrow.parquet as pq
import pytest

from rosterline.plans import reports
from tests.conftest import SMALL
from verification.fixtures import report_tables
from verification.registry import QUERIES

PYTHON_ON_PURPOSE = {"read_workbooks"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "Exchange SinglePartition" not in plan or name in {"search_counts", "preview_rows"}  # one row, and three
    assert name in PYTHON_ON_PURPOSE or not re.search(r"Python|Pandas", plan)


def test_headline_reads_each_fact_once_and_exchanges_once(spark):
    plan = plan_of(reports.report_grain5_d15(report_tables(spark, SMALL)))
    union = plan[plan.index("Union"):]
    facts = union[: union.index("BroadcastExchange")]
    assert facts.count("FileScan") == 6
    assert len(re.findall(r"PartitionFilters: \[isnotnull\(role", facts)) == 6  # partition filters
    assert plan.count("Exchange hashpartitioning") == 3  # facts, departments, accounts
    assert "headcount" not in plan and "is_onsite" not in plan


@pytest.mark.parametrize(
    "name, columns",
    [
        ("search_counts", {"doc_id", "text", "lang", "source", "n_chars"}),
        ("ilike_filter", {"doc_id", "text", "lang", "source"}),
        ("round5", {"l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"}),
        ("avg_text", {"practice", "fte_txt"}),
        ("duplicate_audit", {"account_id"}),
    ],
)
def test_scans_are_pruned(spark, name, columns):
    plan = plan_of(QUERIES[name](spark, SMALL))
    read = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert read and all({field.split(":")[0] for field in each.split(",")} <= columns for each in read)


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[[^\]]*IsNotNull\(role|PartitionFilters: \[isnotnull\(role", plan_of(QUERIES["not_null_filter"](spark, SMALL)))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)" in plan_of(QUERIES["append_if_absent"](spark, SMALL))


def test_descriptions_that_are_text_travel_as_one_text(spark):
    from rosterline.operators.grain import Source
    from rosterline.plans.consolidate import Layout, consolidate

    first, second = (Source(name, {"k": ("k",)}, {}, {"name": ("name",), "size": ("size",)}) for name in ("first", "second"))
    schema = "k string, name string, size int"
    tables = {
        "first": spark.createDataFrame([("a", "", None), ("a", "9x", None), ("b", None, 7), (None, "n", 1)], schema),
        "second": spark.createDataFrame([("a", "0", 3), ("b", "1 é", 12), ("c", None, None)], schema),
    }
    choices = {"name": [(first, "name"), (second, "name")], "size": [(first, "size"), (second, "size")], "own": [(first, "name")]}
    layout = Layout(("k",), (first, second), {}, choices)
    out = consolidate(tables, layout)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "name AS value" not in plan and "size" in plan
    assert out.schema["size"].dataType.simpleString() == "int"
    found = {tuple(row) for row in out.select("k", "name", "size", "own").collect()}
    assert found == {("a", "", 3, ""), ("b", "1 é", 7, None), ("c", None, None, None), (None, None, None, None)}
    assert found == {tuple(row) for row in consolidate(tables, layout, "joined").select("k", "name", "size", "own").collect()}


def test_keys_of_staged_rows_are_written_without_a_dictionary(spark):
    files = report_tables(spark, SMALL)["utilization_prediction_report"].inputFiles()
    chunks = pq.ParquetFile(files[0].removeprefix("file://")).metadata.row_group(0)
    dictionary = {chunks.column(i).path_in_schema: any("DICTIONARY" in each for each in chunks.column(i).encodings) for i in range(chunks.num_columns)}
    assert dictionary["practice"] and not any(dictionary[name] for name in ("l_orderkey", "c_custkey", "c_name"))
