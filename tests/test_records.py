"""CSV files read by many tasks against the same files read by one."""

from __future__ import annotations

import csv
import io
import random

import pytest

from rosterline.sources import ingest, records
from tests.conftest import rows


@pytest.fixture
def small_tasks(spark):
    before = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def one_task(spark, path, monkeypatch):
    monkeypatch.setattr(ingest, "split_records", lambda *_: None)
    whole = ingest._read_csv(spark, path)
    monkeypatch.undo()
    return whole


def made(seed, line, n=120, cell=30):
    draw, out = random.Random(seed), io.StringIO()
    write = csv.writer(out, lineterminator=line)
    write.writerow(["Id", f"Text with{line}break" if seed % 2 else "Text", "Id"])
    letters = ["a", "é", ",", '"', '""', line, " ", f"x{line}y", "", line * 2]
    for i in range(n):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(cell)))
        write.writerow([i, text, *([draw.choice(["", "t"])] if draw.random() < 0.9 else [])])
        if draw.random() < 0.05:
            out.write(line)
    text = out.getvalue()
    return text.rstrip("\r\n") if seed % 3 == 0 else text


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("line", ["\n", "\r\n"])
def test_same_rows(spark, tmp_path, small_tasks, monkeypatch, seed, line):
    path = str(tmp_path / "a.csv")
    (tmp_path / "a.csv").write_bytes(made(seed, line).encode())
    split = ingest._read_csv(spark, path)
    whole = one_task(spark, path, monkeypatch)
    found = records.split_records(spark, path)
    assert found is not None and records._lines(spark, path).rdd.getNumPartitions() > 3
    assert split.columns == whole.columns and rows(split) == rows(whole)


def test_cells_over_several_ranges_and_folders(spark, tmp_path, small_tasks, monkeypatch):
    long = "line\n" * 900
    for name, body in (("p1.csv", f'h,k\n1,"{long}"\n2,b\n'), ("p2.csv", "h,k\n" + "".join(f"{i},plain\n" for i in range(300)))):
        (tmp_path / "d.csv").mkdir(exist_ok=True)
        (tmp_path / "d.csv" / name).write_text(body)
    path = str(tmp_path / "d.csv")
    split = ingest._read_csv(spark, path)
    assert rows(split) == rows(one_task(spark, path, monkeypatch)) and split.count() == 302
    assert any(row["k"] == long for row in split.collect())


@pytest.mark.parametrize(
    "body", ['a,b\n5" pipe,1\n', 'a,b\n "x",1\n', 'a,b\n"x" y,1\n', 'a,b\n"open,1\n', "a,b\r\n1,2\n3,4\r\n", "\na,b\n1,2\n", 'a,b\n"x,"y,1\n'],
)
def test_what_quotes_do_not_tell_is_read_by_one_task(spark, tmp_path, small_tasks, monkeypatch, body):
    path = tmp_path / "a.csv"
    path.write_bytes((body + "".join(f"{i},z\n" for i in range(400))).encode())
    assert records.split_records(spark, str(path)) is None

    def outcome(df):
        try:
            return rows(df)
        except Exception as error:
            return "more cells than headers" in str(error)

    assert outcome(ingest._read_csv(spark, str(path))) == outcome(one_task(spark, str(path), monkeypatch))


def test_byte_order_mark(spark, tmp_path, small_tasks, monkeypatch):
    path = tmp_path / "a.csv"
    path.write_bytes(("\ufeffa,b\n" + "".join(f'{i},"z\n"\n' for i in range(400))).encode())
    split = ingest._read_csv(spark, str(path))
    assert split.count() == 400 and rows(split) == rows(one_task(spark, str(path), monkeypatch))


def test_extra_cells_still_fail_the_file(spark, tmp_path, small_tasks):
    path = tmp_path / "a.csv"
    path.write_text("a,b\n" + "1,2\n" * 400 + "1,2,,,,,,x\n" + "1,2,,,\n" * 20)
    with pytest.raises(Exception, match="more cells than headers"):
        ingest._read_csv(spark, str(path)).collect()
    path.write_text("a,b\n" + "1,2\n" * 400 + "1,2,,,\n" * 20)
    assert ingest._read_csv(spark, str(path)).count() == 420


def test_small_files_are_not_split(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("a\n1\n")
    monkeypatch.setattr(ingest, "split_records", lambda *_: pytest.fail("split"))
    assert ingest._read_csv(spark, str(tmp_path / "a.csv")).count() == 1
    assert ingest._task_bytes(spark) == 128 << 20
