"""Catalog, ingest, contract, export and workbooks, in a temporary warehouse."""

from __future__ import annotations

import datetime as dt
import io
import subprocess
import sys
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rosterline.operators.contract import ContractError, check_contract
from rosterline.operators.headers import check_headers, find_header, strip_headers
from rosterline.session import setting, size_reads, size_shuffles
from rosterline.sources import catalog, workbooks
from rosterline.sources.export import export_rows
from rosterline.sources.ingest import as_text, ingest_batch, ingest_text, read_text, replace_validated
from tests.conftest import rows

AT = dt.datetime(2025, 1, 31, 17, 30)
STAMP = "2025-01-31 23:00:00 IST"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Project Id` int, `Impact_FTE` int, `a.b` int")
    assert find_header(df, "project id") == "Project Id"
    assert find_header(df, "Impact FTE") == "Impact_FTE"
    assert find_header(df, "FTE", "PROJECT_ID") == "Project Id"
    with pytest.raises(ValueError, match="none of the headers"):
        find_header(df, "Practice")
    both = spark.createDataFrame([(1, 2)], "`Impact FTE` int, Impact_FTE int")
    assert find_header(both, "impact_fte") == "Impact_FTE"
    with pytest.raises(ValueError, match="ambiguous"):
        find_header(both, "ImpactFTE")
    assert strip_headers(df.toDF(" x", "y ", "z")).columns == ["x", "y", "z"]
    with pytest.raises(ValueError, match="differ only in case"):
        check_headers(df.toDF("Account Id", "x", "Account ID"))


def test_ingest_csv_as_text(spark, database, tmp_path):
    path = write(tmp_path / "a.csv", ' Id ,Name\n007,"two\nlines, ""quoted"""\n,n/a\n1.50,NULL\n')
    df = ingest_text(spark, path, f"{database}.t", AT)
    assert df.dtypes == [("Id", "string"), ("Name", "string"), ("load_date", "string")]
    assert rows(df) == sorted(
        [("007", 'two\nlines, "quoted"', STAMP), ("1.50", None, STAMP), (None, None, STAMP)], key=lambda r: [(v is None, str(v)) for v in r]
    )


def test_ingest_typed_source(spark, database, tmp_path):
    path = str(tmp_path / "typed.parquet")
    spark.createDataFrame([(1, 2.5, True, dt.date(2025, 1, 2))], "a int, b double, c boolean, d date").write.parquet(path)
    assert rows(ingest_text(spark, path, f"{database}.t", AT)) == [("1", "2.5", "true", "2025-01-02", STAMP)]


def test_batch_reports_each_file(spark, database, tmp_path):
    (tmp_path / "x").mkdir()
    paths = [
        write(tmp_path / "My Plan.csv", "a\n1\n2\n"), str(tmp_path / "missing.csv"), write(tmp_path / "twice.csv", "a,A\n1,2\n"),
        write(tmp_path / "x" / "my plan.csv", "a\n3\n"),
    ]
    status = ingest_batch(spark, paths, database, AT)
    found = {row["path"]: (row["table"], row["status"], row["rows"]) for row in status.collect()}
    assert found[paths[0]] == ("my_plan", "replaced", 2)
    assert found[paths[3]] == ("my_plan", "complete", 1)
    assert found[paths[1]] == ("missing", "failed", None)
    errors = {row["path"]: row["error"] for row in status.collect()}
    assert "PATH_NOT_FOUND" in errors[paths[1]] and errors[paths[0]] is None
    assert rows(catalog.read_table(spark, f"{database}.my_plan")) == [("3", STAMP)]


def test_replace_table_from_itself_and_with_new_schema(spark, database):
    name = f"{database}.t"
    catalog.replace_table(spark, name, spark.range(3).select("id"))
    catalog.replace_table(spark, name, spark.table(name).withColumn("Next Id", F.col("id") + 1))
    assert rows(spark.table(name)) == [(0, 1), (1, 2), (2, 3)]
    assert [t.name for t in spark.catalog.listTables(database) if not t.isTemporary] == ["t"]


def test_failed_write_keeps_table(spark, database):
    name = f"{database}.t"
    catalog.replace_table(spark, name, spark.range(3))
    with pytest.raises(Exception):
        catalog.replace_table(spark, name, spark.range(3).select(F.raise_error(F.lit("no")).alias("id")))
    assert spark.table(name).count() == 3


def test_view_is_not_replaced_by_a_table(spark, database):
    catalog.replace_table(spark, f"{database}.base", spark.range(3))
    catalog.replace_view(spark, f"{database}.v", f"SELECT * FROM {database}.base")
    with pytest.raises(Exception):
        catalog.replace_table(spark, f"{database}.v", spark.range(9))
    assert spark.table(f"{database}.v").count() == 3
    assert [t.name for t in spark.catalog.listTables(database) if not t.isTemporary] == ["base", "v"]


def test_odd_table_name(spark, database):
    name = f"{database}.select"
    catalog.replace_table(spark, name, spark.range(2))
    assert catalog.read_table(spark, name).count() == 2
    assert catalog.drop_relation(spark, name) == "table"


def test_views_and_drop(spark, database):
    catalog.replace_table(spark, f"{database}.base", spark.range(5))
    catalog.replace_view(spark, f"{database}.v", f"SELECT id FROM {database}.base WHERE id > 1")
    assert catalog.replace_view(spark, f"{database}.v", f"SELECT MAX(id) AS top FROM {database}.base").collect()[0]["top"] == 4
    assert ("v", "view") in rows(catalog.list_tables(spark, database))
    assert catalog.drop_relation(spark, f"{database}.v") == "view"
    assert catalog.drop_relation(spark, f"{database}.v") is None
    assert catalog.drop_relation(spark, f"{database}.base") == "table"
    assert catalog.replace_view(spark, "session_view", spark.range(2)).count() == 2
    assert catalog.drop_relation(spark, "session_view") == "view"


def test_describe(spark, database):
    catalog.replace_table(spark, f"{database}.t", spark.createDataFrame([("a", 1)], "`Project Id` string, n int"))
    assert rows(catalog.describe_tables(spark, [f"{database}.t"])) == [
        (f"{database}.t", 1, "Project Id", "STRING"), (f"{database}.t", 2, "n", "INT"),
    ]
    text = catalog.schema_text(spark, [f"{database}.t", f"{database}.t"])
    assert text == "\n\n".join([f"Table: {database}.t\nColumns: Project Id (STRING), n (INT)"] * 2)
    assert catalog.schema_text(spark, []) == "No tables selected."


def test_contract(spark, database):
    live = spark.createDataFrame([("1", "x")], "a string, B string")
    assert rows(check_contract(live, live.toDF("a", "b"))) == [("B", "missing"), ("a", "ok"), ("b", "extra")]
    name = f"{database}.t"
    catalog.replace_table(spark, name, live.withColumn("load_date", F.lit("old")))
    with pytest.raises(ContractError) as caught:
        replace_validated(spark, name, live.drop("B"), AT)
    assert caught.value.missing == ["B"]
    assert rows(spark.table(name)) == [("1", "x", "old")]
    assert replace_validated(spark, name, live.toDF(" a", "B ").withColumn("c", F.lit(1)), AT) == ["c"]
    assert rows(spark.table(name)) == [("1", "x", "1", STAMP)]


@pytest.mark.parametrize("file_format", ["csv", "parquet"])
def test_export(spark, tmp_path, file_format):
    df = spark.createDataFrame([("a\nb", '"q", \\', None), ("", "ü", "1")], "x string, `y z` string, n string")
    for name, data in {"full": df, "empty": df.filter("n = '2'")}.items():
        path = str(tmp_path / f"{name}.{file_format}")
        export_rows(data, path, file_format)
        back = read_text(spark, path)
        assert back.columns == ["x", "y z", "n"]
        assert rows(back) == rows(as_text(data))


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_export_workbooks(spark, tmp_path, scheme):
    df = spark.createDataFrame([("a\nb", None), ("ü", "1")], "x string, `y z` string").repartition(2)
    export_rows(df, f"{scheme}{tmp_path}/full", "xlsx")
    assert rows(read_text(spark, f"{tmp_path}/full/*.xlsx")) == rows(df)
    assert not [each.name for each in (tmp_path / "full").iterdir() if not each.name.endswith(".xlsx")]
    with pytest.raises(FileExistsError):
        export_rows(df, f"{scheme}{tmp_path}/full", "xlsx")
    export_rows(df.filter("x = 'z'"), f"{scheme}{tmp_path}/empty", "xlsx")
    assert read_text(spark, f"{tmp_path}/empty/*.xlsx").columns == ["x", "y z"]
    assert read_text(spark, f"{tmp_path}/empty/*.xlsx").count() == 0


def test_control_characters_in_workbooks(spark, tmp_path):
    df = spark.createDataFrame([("x\x0by", "_x000B_"), ("a_x", "_x_x0041_\x01")], "x string, y string")
    export_rows(df, f"{tmp_path}/odd", "xlsx")
    assert rows(read_text(spark, f"{tmp_path}/odd/*.xlsx")) == rows(df)


def test_dotted_names(spark, database, tmp_path):
    path = write(tmp_path / "Report 1.2.csv", "a\n1\n")
    load = ingest_batch(spark, [path], database).first()
    # This catalog takes no dots in names, which the status says.
    assert load["table"] == "report_1.2" and load["status"] == "failed" and "not a valid name" in load["error"]
    name = f"`{database}`.`plain`"
    assert catalog.replace_table(spark, name, spark.range(2)).count() == 2
    assert catalog.replace_table(spark, name, spark.range(3)).count() == 3


def cells(*rows_):
    body = "".join(rows_)
    return f'<worksheet xmlns="{workbooks.MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>'


def workbook(sheet, **parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as book:
        for name, text in {**workbooks.PARTS, "xl/worksheets/sheet1.xml": sheet, **parts}.items():
            book.writestr(name, text)
    return buffer.getvalue()


def test_cell_kinds():
    space = f'xmlns="{workbooks.MAIN[1:-1]}"'
    sheet = cells(
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>In</t></is></c></row>',
        '<row r="3"><c r="A3"><v>5</v></c><c r="B3"><v>0.1</v></c><c r="C3" s="1"><v>45000.5</v></c><c r="D3" t="b"><v>1</v></c>'
        '<c r="E3" t="e"><v>#N/A</v></c><c r="AA3" t="str"><v>far</v></c></row>',
        '<row r="4"><c r="A4"/></row>',
    )
    content = workbook(
        sheet,
        **{
            "xl/sharedStrings.xml": f"<sst {space}><si><t>Id</t></si><si><r><t>Ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>",
            "xl/styles.xml": f'<styleSheet {space}><numFmts><numFmt numFmtId="164" formatCode="yyyy&quot;x&quot;"/></numFmts>'
            '<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        },
    )
    found = list(workbooks.sheet_rows(content))
    assert found[0] == (0, ["Id", "Rich", None, "In"])
    assert found[1] == (1, [])
    assert found[2] == (2, ["5", "0.1", "2023-03-15 12:00:00", "True", None, *[None] * 21, "far"])
    assert len(found) == 3  # the blank row at the end is not data


def test_workbook_files(spark, database, tmp_path):
    df = spark.createDataFrame([("a", None), ("ü <&>\r\n", "2")], "Name string, `Project Id` string")
    for row in workbooks.to_workbooks(df.coalesce(1), "part").collect():
        (tmp_path / "Head Count.xlsx").write_bytes(row["content"])
    path = str(tmp_path / "Head Count.xlsx")
    assert rows(read_text(spark, path)) == rows(df)
    assert rows(workbooks.read_workbooks(spark, str(tmp_path / "*.xlsx")).select("row", "col", "value")) == [
        (0, 0, "Name"), (0, 1, "Project Id"), (1, 0, "a"), (2, 0, "ü <&>\r\n"), (2, 1, "2"),
    ]
    assert [row["status"] for row in ingest_batch(spark, [path], database, AT).collect()] == ["complete"]
    assert catalog.read_table(spark, f"{database}.head_count").columns == ["Name", "Project Id", "load_date"]


def test_full_sheets_start_new_workbooks(spark):
    df = spark.range(0, 25, numPartitions=1).select(F.col("id").cast("string").alias("id"))
    files = workbooks.to_workbooks(df, "part", sheet_rows=11)
    assert [row["path"] for row in files.select("path").orderBy("path").collect()] == [f"part-00000-{i:03d}.xlsx" for i in range(3)]
    assert rows(workbooks.workbook_wide(files)) == rows(df)
    mixed = files.unionByName(workbooks.to_workbooks(df.withColumnRenamed("id", "other"), "other"))
    with pytest.raises(ValueError, match="different headers"):
        workbooks.workbook_wide(mixed)


def test_workbook_tasks_need_no_package(tmp_path):
    """A worker without this repository on its path can run the parser."""
    (tmp_path / "task").write_bytes(cloudpickle.dumps(workbooks._parse(False)))
    (tmp_path / "book").write_bytes(workbook(cells('<row r="1"><c r="A1"><v>5</v></c></row>')))
    script = (
        "import pickle, pandas as pd, sys\n"
        "parse = pickle.load(open('task', 'rb'))\n"
        "batch = pd.DataFrame({'path': ['p'], 'content': [open('book', 'rb').read()]})\n"
        "print([list(row) for row in next(parse([batch])).itertuples(index=False)])\n"
        "assert 'rosterline' not in sys.modules\n"
    )
    done = subprocess.run([sys.executable, "-I", "-c", script], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.strip() == "[['p', 0, ['5']]]", done.stderr


def test_shuffles_are_sized_by_the_files(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.range(100_000).write.parquet(str(tmp_path / "a"))
    try:
        assert size_shuffles(spark, str(tmp_path)) == int(before)
        assert size_shuffles(spark, str(tmp_path), bytes_per_partition=1000) > 100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tasks_stay_small_whatever_the_size_of_the_files(spark, tmp_path):
    with (tmp_path / "large.parquet").open("wb") as file:
        file.truncate(400 << 20)
    reads = "spark.sql.files.minPartitionNum"
    with setting(spark, "spark.sql.shuffle.partitions", "8"), setting(spark, reads, "9"):
        size_reads(spark, size_shuffles(spark, str(tmp_path)))
        assert spark.conf.get("spark.sql.shuffle.partitions") == spark.conf.get(reads) == "50"
        size_reads(spark, 10)
        assert spark.conf.get(reads) == "50"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
