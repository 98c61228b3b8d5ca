"""From uploaded workbooks to the saved report, its roll-up and an export."""

from __future__ import annotations

import datetime as dt

from rosterline.plans import reports
from rosterline.plans.rollup import pdl_rollup
from rosterline.sources.catalog import catalog_tables, classify_tables, list_tables, replace_table, replace_view
from rosterline.sources.export import export_rows
from rosterline.sources.ingest import ingest_batch, read_text
from rosterline.sources.workbooks import to_workbooks
from rosterline.operators.explore import query_status, search_any
from tests.conftest import rows
from tests.test_reports import tables  # noqa: F401


def test_workbooks_to_report(spark, database, tables, tmp_path):  # noqa: F811
    paths = []
    for name, df in tables.items():
        path = tmp_path / f"{name.replace('_', ' ').title()}.xlsx"
        path.write_bytes(to_workbooks(df.coalesce(1), name).head()["content"])
        paths.append(str(path))
    status = ingest_batch(spark, paths, database, dt.datetime(2025, 1, 31))
    assert {row["status"] for row in status.collect()} == {"complete"}

    loaded = catalog_tables(spark, database)
    assert set(loaded) == set(tables)
    report = reports.report_grain5_d15(loaded)
    assert rows(report) == rows(reports.report_grain5_d15(tables))

    saved = replace_table(spark, f"{database}.dashboard_master", report)
    assert saved.columns == report.columns and rows(saved) == rows(report)
    replace_view(spark, "dashboard", reports.report_grain4_d8(loaded))
    replace_view(spark, "pdl_summary", pdl_rollup(spark.table("dashboard")))
    groups = {row["table"]: row for row in classify_tables(list_tables(spark, database)).collect()}
    assert groups["map_bu"]["is_lookup"] and groups["dashboard_master"]["is_view"] and groups["attrition"]["is_transaction"]

    answer = query_status(spark, "SELECT `PDL Name`, last_bfte FROM pdl_summary WHERE `PDL Name` ILIKE '%lead%'")
    assert answer.status == "ok" and "Lead" in answer.text

    out = str(tmp_path / "download.csv")
    export_rows(search_any(saved, "closed"), out)
    assert [row["Project Id"] for row in read_text(spark, out).collect()] == ["closed"]
    for name in ("dashboard", "pdl_summary"):
        spark.catalog.dropTempView(name)
