"""Files to all-text tables."""

from __future__ import annotations

import csv
import datetime as dt
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rosterline.functions import ist_text, table_name_expr
from rosterline.operators.contract import ContractError, check_contract
from rosterline.operators.headers import check_headers, check_names, column, number_repeats, quoted, strip_headers
from rosterline.session import data_files
from rosterline.sources.catalog import MANY, new_version, point, read_table, replace_table
from rosterline.sources.records import split_records
from rosterline.sources.workbooks import workbook_table

LOAD_DATE = "load_date"
OTHER_SUFFIXES = r"(?i)\.(csv|parquet|orc|json)$"

# Cell texts that count as empty.
EMPTY_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text, with empty cells as NULL."""

    return df.select(*[_cell(column(df, name).cast("string")).alias(name) for name in df.columns])


def _cell(text: Column) -> Column:
    return F.when(~text.isin(*EMPTY_TEXTS), text)


def stamp_load_date(df: DataFrame, at: dt.datetime | None = None) -> DataFrame:
    """Add the load time as text in Indian Standard Time. ``at`` is a fixed time in UTC, for tests."""
    if at is None:
        stamp = ist_text(suffix=" IST")
    else:
        stamp = ist_text(F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz"), " IST", F.lit("UTC"))
    return df.withColumn(LOAD_DATE, stamp)


CSV = {"multiLine": True, "escape": '"'}


def _places(n: int) -> StructType:
    """Columns by position, and what could not be read so."""
    return StructType([StructField(f"_{i}", StringType()) for i in range(n)] + [StructField("_bad", StringType())])


def _beyond(places: list[str], columns: Column | None = None) -> Column:
    """Whether a row that does not have one cell per place has a filled cell behind the first ``columns`` of them, or all.

    Behind its last filled cell comes a mark; if it lies beyond the columns, so does that cell.
    """
    columns = F.lit(len(places)) if columns is None else columns
    mark = uuid.uuid4().hex
    filled = F.regexp_replace("_bad", r"[,\r\n]+$", "")
    commas = F.length(filled) - F.length(F.replace(filled, F.lit(",")))
    cells = [*places, f"_{len(places)}"]
    parsed = F.from_csv(F.concat(filled, F.lit(f",{mark}")), ", ".join(f"`{name}` string" for name in cells), {"escape": '"', "multiLine": "true"})
    first = F.slice(F.array(*[parsed[name] for name in cells]), F.lit(1), columns + 1)
    return F.when(F.col("_bad").isNotNull() & (commas >= columns), ~F.coalesce(F.array_contains(first, mark), F.lit(False))).otherwise(False)


def _header(cells: Iterable[str | None]) -> list[str]:
    return number_repeats([(name or f"Unnamed: {i}").strip() for i, name in enumerate(cells)])


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as text, its repeated headers numbered; short rows are filled up with NULL.

    A row with more filled cells than the header has columns fails the file, so that no cell is lost. Files too
    large for one task are split (see ``split_records``); the others, and those that cannot be, are a task each.
    """
    first = spark.read.options(**CSV).csv(path, header=False).first()
    if first is None:
        raise ValueError(f"{path!r} is empty")
    names = _header(first)
    places, schema = [f"_{i}" for i in range(len(names))], _places(len(names))
    options = {**CSV, "columnNameOfCorruptRecord": "_bad"}
    records = split_records(spark, path) if _largest(spark, path) > _task_bytes(spark) else None
    if records is None:
        rows = spark.read.options(**options, enforceSchema=True).schema(schema).csv(path, header=True)
    else:
        texts = {name: str(value).lower() if isinstance(value, bool) else value for name, value in options.items()}
        rows = records.select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), texts).alias("cells")).select("cells.*")
    failed = F.raise_error(F.concat(F.lit("row with more cells than headers: "), F.col("_bad")))
    checked = F.when(_beyond(places), failed.cast("string")).otherwise(F.col(places[0]))
    return rows.select(checked.alias(places[0]), *places[1:]).toDF(*names)


def _largest(spark: SparkSession, path: str) -> int:
    return max((size for _, size in data_files(spark, path)), default=0)


def _task_bytes(spark: SparkSession) -> int:
    """How much of a file one task reads; the setting is a number with or without a unit."""
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A file as an all-text frame, by its suffix: workbook, CSV, or any typed Spark source."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "xlsx":
        df = workbook_table(spark, path)
    elif suffix in ("parquet", "orc", "json"):
        df = spark.read.format(suffix).load(path)
    elif suffix == "csv":
        df = _read_csv(spark, path)
    else:
        raise ValueError(f"cannot read {path!r}: unknown suffix {suffix!r}")
    return as_text(strip_headers(df))


def ingest_text(spark: SparkSession, path: str, table: str, at: dt.datetime | None = None) -> DataFrame:
    """Load a file as an all-text table stamped with the load time, replacing any table of that name."""
    df = read_text(spark, path)
    check_headers(df)
    return replace_table(spark, table, stamp_load_date(df, at))


def table_names(spark: SparkSession, paths: list[str]) -> list[str]:
    """Table name of each path, from its last part without the suffix."""
    files = [re.sub(OTHER_SUFFIXES, "", path.rstrip("/").rsplit("/", 1)[-1]) for path in paths]
    named = spark.createDataFrame(list(enumerate(files)), "i int, file string")
    return [row["table"] for row in named.select("i", table_name_expr(F.col("file")).alias("table")).orderBy("i").collect()]


@dataclass(frozen=True)
class _Load:
    path: str
    table: str
    status: str
    rows: int | None
    error: str | None


def ingest_batch(
    spark: SparkSession, paths: list[str], database: str | None = None, at: dt.datetime | None = None, parallel: int = 8
) -> DataFrame:
    """Load each file to its own table; a file that fails does not stop the others.

    CSV files of which a task reads one whole are loaded together, in a number of jobs that does not grow with
    theirs; large ones, other kinds and what turns out unreadable, each by itself, ``parallel`` at a time. The result
    says per file whether its table is ``complete``, ``failed``, or ``replaced`` by a later file of the same table name.
    """
    names = table_names(spark, paths)
    by_table: dict[str, list[int]] = defaultdict(list)
    for i, name in enumerate(names):
        by_table[name].append(i)

    def target(name: str) -> str:
        return f"{quoted(database)}.{quoted(name)}" if database else quoted(name)

    def load(i: int) -> _Load:
        try:
            return _Load(paths[i], names[i], "complete", ingest_text(spark, paths[i], target(names[i]), at).count(), None)
        except Exception as error:  # reported in the status frame
            return _Load(paths[i], names[i], "failed", None, str(error))

    files = {i: data_files(spark, path) for i, path in enumerate(paths) if path.rstrip("/").lower().endswith(".csv")}
    most = _task_bytes(spark)
    small = {i for i, found in files.items() if found and max(size for _, size in found) <= most}
    together = {i: files[i] for indices in by_table.values() if small.issuperset(indices) for i in indices}
    loads = _load_together(spark, together, paths, names, target, database or spark.catalog.currentDatabase(), at) if together else {}

    def load_in_order(indices: list[int]) -> dict[int, _Load]:
        return {i: load(i) for i in indices}

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        for done in pool.map(load_in_order, [left for indices in by_table.values() if (left := [i for i in indices if i not in loads])]):
            loads |= done
    for indices in by_table.values():
        for i in [i for i in indices if loads[i].status == "complete"][:-1]:
            loads[i] = replace(loads[i], status="replaced")
    return spark.createDataFrame(
        [(each.path, each.table, each.status, each.rows, each.error) for each in (loads[i] for i in range(len(paths)))],
        "path string, table string, status string, rows long, error string",
    )


def _first_lines(spark: SparkSession, locations: list[str]) -> dict[str, str]:
    """The first line of each file that has one and ends no later: files that begin otherwise are left out."""
    lines = spark.read.option("lineSep", "\n").text(locations)
    numbered = lines.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("value"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    first = numbered.groupBy("file").agg(F.min_by("value", "id").alias("value"))
    return {row["file"]: row["value"] for row in first.filter((quotes % 2 == 0) & (F.trim("value") != "") & ~F.contains("value", F.lit("\r"))).collect()}


def _load_together(
    spark: SparkSession, files: dict[int, list[tuple[str, int]]], paths: list[str], names: list[str],
    target: Callable[[str], str], database: str, at: dt.datetime | None,
) -> dict[int, _Load]:
    """Load files by one read and one write, and point each table to its part; some may be left for another way.

    Cells are read by position, in as many columns as the widest file has, and written to one version,
    partitioned by file, beside which cell is whose header is known here. A file fails if a row has more filled
    cells than its header. Jobs: the first lines, the write, and a count per file.
    """
    first = _first_lines(spark, [location for found in files.values() for location, _ in found])
    plain = {unquote(file).split(":", 1)[-1].lstrip("/"): (file, line) for file, line in first.items()}
    headers: dict[int, list[str]] = {}
    owners: list[tuple[str, int, int]] = []
    loads: dict[int, _Load] = {}
    for i, found in files.items():
        known = [plain.get(location.split(":", 1)[-1].lstrip("/")) for location, _ in found]
        if None in known:
            continue
        names_here = _header(next(csv.reader([known[0][1]])))
        try:
            check_names(names_here)
        except ValueError as error:
            loads[i] = _Load(paths[i], names[i], "failed", None, str(error))
            continue
        headers[i] = names_here
        owners += [(file, i, len(names_here)) for file, _ in known]
    if not headers:
        return loads
    places = [f"_{i}" for i in range(max(map(len, headers.values())))]
    read = spark.read.options(**CSV, columnNameOfCorruptRecord="_bad", enforceSchema=True, header=True).schema(_places(len(places)))
    rows = read.csv([location for i in headers for location, _ in files[i]]).select("*", F.col("_metadata.file_path").alias("__path"))
    known = spark.createDataFrame(owners, "__path string, __file int, __columns int")  # a row per file
    cells = [_cell(F.col(name)).alias(name) for name in places]
    extra = _beyond(places, F.col("__columns")).alias("__extra")
    kept = stamp_load_date(rows.join(F.broadcast(known), "__path").select(*cells, extra, "__file"), at)
    version = new_version(spark, database, MANY)
    kept.write.format("parquet").partitionBy("__file").saveAsTable(version)
    counted = spark.table(version).groupBy("__file").agg(F.count(F.lit(1)).alias("rows"), F.count_if("__extra").alias("extra"))
    counts = {row["__file"]: row for row in counted.collect()}  # a row per file
    last: dict[str, int] = {}
    for i in sorted(headers):
        row = counts.get(i)
        if row and row["extra"]:
            loads[i] = _Load(paths[i], names[i], "failed", None, f"{row['extra']} rows with more cells than headers")
        else:
            loads[i] = _Load(paths[i], names[i], "complete", row["rows"] if row else 0, None)
            last[names[i]] = i
    for name, i in last.items():
        fields = [LOAD_DATE if header.lower() == LOAD_DATE else f"{place} AS {quoted(header)}" for place, header in zip(places, headers[i])]
        fields += [] if LOAD_DATE in map(str.lower, headers[i]) else [LOAD_DATE]
        try:
            point(spark, target(name), f"SELECT {', '.join(fields)} FROM {version} WHERE __file = {i}")
        except Exception as error:  # reported in the status frame
            for j in (j for j in headers if names[j] == name):
                loads[j] = _Load(paths[j], name, "failed", None, str(error))
    return loads


def replace_validated(spark: SparkSession, table: str, new: DataFrame, at: dt.datetime | None = None) -> list[str]:
    """Replace the table if the new data has all its columns; returns the columns that are extra.

    Raises ``ContractError``, and leaves the table as it is, when any column is missing.
    """
    stamped = stamp_load_date(as_text(strip_headers(new)), at)
    states = check_contract(read_table(spark, table), stamped).collect()
    missing = sorted(row["column"] for row in states if row["state"] == "missing")
    if missing:
        raise ContractError(missing)
    replace_table(spark, table, stamped)
    return sorted(row["column"] for row in states if row["state"] == "extra")
