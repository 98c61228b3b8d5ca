"""Tables and views of the session catalog.

A stored table is a name that points to its latest version. Each version is a table of its own in a companion
database, written once and never changed; the name is a view of one version, and replacing the table is
replacing that view: one change in the catalog, whatever the columns, with no moment without a table. A reader
that has begun goes on with the version it began with, until ``sweep_versions`` removes it.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterline.operators.headers import check_headers, quoted

# The name prefixes that sort tables into groups.
NOT_TRANSACTIONS = ("map_", "_ref", "v_", "dashboard", "archive", "arv", "pdl_summary")
LOOKUPS = ("map_",)
VIEWS = ("pdl", "dashboard")


VERSIONS = "{}__versions"
POINTER = "stored table"  # comment of the views that are tables
MANY = "_many"  # name of the versions that hold the rows of several tables
KEEP = dt.timedelta(days=1)
_VERSION_TIME = "%Y%m%d%H%M%S%f"
_VERSION_NAME = re.compile(r"^(.+)__v(\d{20})_[0-9a-f]{6}$", re.DOTALL)


def _name_parts(name: str) -> list[str]:
    """The parts of a name; one in backticks may hold dots."""
    return [part[1:-1].replace("``", "`") if part[0] == "`" else part for part in re.findall(r"`(?:[^`]|``)+`|[^.`]+", name)]


def _identifier(name: str) -> str:
    return ".".join(quoted(part) for part in _name_parts(name))


def database_and_table(spark: SparkSession, name: str) -> tuple[str, str]:
    *database, table = _name_parts(name)
    return database[-1] if database else spark.catalog.currentDatabase(), table


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(_identifier(name))


def _versions(spark: SparkSession, database: str) -> dict[str, list[str]]:
    """Names of the versions by table, the oldest first."""
    found: dict[str, list[str]] = {}
    if spark.catalog.databaseExists(quoted(VERSIONS.format(database))):
        for each in sorted(t.name for t in spark.catalog.listTables(quoted(VERSIONS.format(database))) if not t.isTemporary):
            if match := _VERSION_NAME.match(each):
                found.setdefault(match[1], []).append(each)
    return found


def _kind_of(found) -> str:
    """``table`` for a name that points to a version, ``plain table`` for any other table, or ``view``."""
    if found.tableType not in ("VIEW", "TEMPORARY"):
        return "plain table"
    return "table" if found.description == POINTER and not found.isTemporary else "view"


def _relations(spark: SparkSession, database: str | None) -> list[tuple[str, str, bool]]:
    """(name, kind, whether of the session only) of all tables and views."""
    listed = spark.catalog.listTables(quoted(database)) if database else spark.catalog.listTables()
    return [(t.name, _kind_of(t).removeprefix("plain "), t.isTemporary) for t in listed]


def catalog_tables(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """Every table of the database by name, as the reports take them."""
    prefix = f"{quoted(database)}." if database else ""
    return {name: read_table(spark, prefix + quoted(name)) for name, kind, _ in _relations(spark, database) if kind == "table"}


def relation_kind(spark: SparkSession, name: str) -> str | None:
    return _kind_of(spark.catalog.getTable(_identifier(name))) if spark.catalog.tableExists(_identifier(name)) else None


def _versions_database(spark: SparkSession, database: str) -> str:
    """The companion database, made beside the tables if it is not there yet."""
    name = VERSIONS.format(database)
    if not spark.catalog.databaseExists(quoted(name)):
        location = spark.catalog.getDatabase(quoted(database)).locationUri.rstrip("/")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(name)} LOCATION '{location}/{name}'")
    return name


def replace_table(
    spark: SparkSession, name: str, df: DataFrame, keep: dt.timedelta = KEEP, buckets: tuple[int, str] | None = None
) -> DataFrame:
    """Create the table, or replace it with its schema; ``df`` may read the table itself.

    With ``buckets``, a number and a column, rows with equal values lie in one of so many files, sorted by it.

    The rows are written as a new version, and then the name is made to point to it. If either fails, the name
    still shows the old rows. Versions out of use for longer than ``keep`` are removed. A table that something else
    made is taken over on its first replacement, and only then is there a moment without it.
    """
    check_headers(df)
    if relation_kind(spark, name) == "view":
        raise ValueError(f"{name} is a view, not a table")
    database, table = database_and_table(spark, name)
    version = new_version(spark, database, table)
    if buckets:
        df.repartition(buckets[0], buckets[1]).write.format("parquet").bucketBy(*buckets).sortBy(buckets[1]).saveAsTable(version)
    else:
        df.write.format("parquet").saveAsTable(version)
    try:
        replaced = point(spark, name, f"SELECT * FROM {version}")
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {version}")
        raise
    if replaced:
        sweep_versions(spark, database, keep, table)
    return read_table(spark, name)


def new_version(spark: SparkSession, database: str, table: str) -> str:
    """A name for a version of the table, by the present time."""
    time = dt.datetime.now(dt.timezone.utc).strftime(_VERSION_TIME)
    return f"{quoted(_versions_database(spark, database))}.{quoted(f'{table.lower()}__v{time}_{uuid.uuid4().hex[:6]}')}"


def point(spark: SparkSession, name: str, select: str) -> bool:
    """Make the name a table that shows these rows of a version; whether it was such a table before."""
    kind = relation_kind(spark, name)
    if kind == "view":
        raise ValueError(f"{name} is a view, not a table")
    database, table = database_and_table(spark, name)
    target = f"{quoted(database)}.{quoted(table)}"
    former = f"{quoted(database)}.{quoted(f'{table}__former_{uuid.uuid4().hex[:6]}')}"
    if kind == "plain table":
        spark.sql(f"ALTER TABLE {target} RENAME TO {former}")
    try:
        spark.sql(f"CREATE OR REPLACE VIEW {target} COMMENT '{POINTER}' AS {select}")
    except Exception:
        if kind == "plain table":
            spark.sql(f"ALTER TABLE {former} RENAME TO {target}")
        raise
    if kind == "plain table":
        spark.sql(f"DROP TABLE {former}")
    return kind == "table"


def current_versions(spark: SparkSession, database: str, table: str) -> list[str]:
    """The versions that the name points to, in their order; none if it is no such table."""
    name = f"{quoted(database)}.{quoted(table)}"
    if relation_kind(spark, name) != "table":
        return []
    text = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'View Text'").first()["data_type"]
    return [_name_parts(each)[-1] for each in re.findall(r" FROM ((?:`(?:[^`]|``)+`\.)+`(?:[^`]|``)+`)", text)]


def shows_whole_versions(spark: SparkSession, database: str, table: str) -> bool:
    """Whether the name is a table whose rows and columns are those of its versions."""
    name = f"{quoted(database)}.{quoted(table)}"
    if relation_kind(spark, name) != "table":
        return False
    text = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'View Text'").first()["data_type"]
    return all(re.fullmatch(r"SELECT \* FROM (`(?:[^`]|``)+`\.)+`(?:[^`]|``)+`", each) for each in text.split("\nUNION ALL "))


def index_of(version: str) -> str:
    """The name of the search index of a version."""
    return f"{version}__trigrams"


def _made(version: str) -> str:
    return _VERSION_NAME.match(version)[2]


def sweep_versions(spark: SparkSession, database: str, keep: dt.timedelta = KEEP, table: str | None = None) -> list[str]:
    """Remove versions that no name points to, once another took their place longer than ``keep`` ago; returns them.

    Versions whose table is gone, and what an interrupted replacement has left, go as soon as they are that old;
    those that held several tables when each of these has had a later version for so long. With ``table``, only its own.
    """
    limit = (dt.datetime.now(dt.timezone.utc) - keep).strftime(_VERSION_TIME)
    groups = _versions(spark, database)
    if table is not None:
        groups = {name: versions for name, versions in groups.items() if name == table.lower() and len(versions) > 1}
    names = [name for name, kind, _ in _relations(spark, database) if kind == "table"] if groups and table is None else list(groups)
    current = {name.lower(): current_versions(spark, database, name) for name in names}
    in_use = {version for versions in current.values() for version in versions}
    newest = max(map(_made, in_use), default="")
    gone = []
    for name, versions in groups.items():
        for version, following in zip(versions, [*versions[1:], None]):
            if name == MANY:
                out_of_use = max(newest, _made(version))
            else:
                out_of_use = _made(max([version, following] if following else [version, *current.get(name, [])], key=_made))
            if version not in in_use and out_of_use <= limit:
                gone.append(version)
    for version in gone:
        _drop_version(spark, database, version)
    return gone


def _drop_version(spark: SparkSession, database: str, version: str) -> None:
    for each in (version, index_of(version)):
        spark.sql(f"DROP TABLE IF EXISTS {quoted(VERSIONS.format(database))}.{quoted(each)}")


def replace_view(spark: SparkSession, name: str, body: DataFrame | str) -> DataFrame:
    """Create or replace a view: a lasting one over SQL text, one for this session over a DataFrame.

    A lasting view names its tables, so it shows what they hold when it is read. See ``plans.standing`` for the
    text of the reports.
    """
    if isinstance(body, str):
        if (relation_kind(spark, name) or "view") != "view":
            raise ValueError(f"{name} is a table, not a view")
        spark.sql(f"CREATE OR REPLACE VIEW {_identifier(name)} AS {body}")
    else:
        body.createOrReplaceTempView(name)
    return read_table(spark, name)


def list_tables(spark: SparkSession, database: str | None = None, session_views: bool | None = None) -> DataFrame:
    """Names of all tables and views, with their kind.

    Views of the session belong to no database: they are listed if asked for, or if no database is named.
    """
    with_session = database is None if session_views is None else session_views
    rows = [(name, kind) for name, kind, of_session in _relations(spark, database) if with_session or not of_session]
    return spark.createDataFrame(rows, "table string, kind string")


def _starts_with_any(name: Column, prefixes: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | name.startswith(prefix)
    return hit


def classify_tables(names: DataFrame, name: str = "table") -> DataFrame:
    """Add the three groups a name can be in: it may be in two of them, or in none."""
    col = F.col(name)
    return names.select(
        "*",
        (~_starts_with_any(col, NOT_TRANSACTIONS)).alias("is_transaction"),
        _starts_with_any(col, LOOKUPS).alias("is_lookup"),
        _starts_with_any(col, VIEWS).alias("is_view"),
    )


def describe_tables(spark: SparkSession, names: list[str]) -> DataFrame:
    """Column names and types in table order."""
    rows = [
        (name, position, column, kind.upper())
        for name in names
        for position, (column, kind) in enumerate(read_table(spark, name).dtypes, start=1)
    ]
    return spark.createDataFrame(rows, "table string, position int, column string, type string")


def schema_text(spark: SparkSession, names: list[str]) -> str:
    """The columns that ``describe_tables`` lists, as text for a reader."""
    if not names:
        return "No tables selected."
    listed = F.array_sort(F.collect_list(F.struct("position", F.format_string("%s (%s)", "column", "type").alias("item"))))
    block = F.concat(F.lit("Table: "), F.col("table"), F.lit("\nColumns: "), F.array_join(listed["item"], ", "))
    described = describe_tables(spark, list(dict.fromkeys(names))).groupBy("table").agg(block.alias("block"))
    blocks = {row["table"]: row["block"] for row in described.collect()}  # one short text per table
    return "\n\n".join(blocks[name] for name in names)


def drop_relation(spark: SparkSession, name: str) -> str | None:
    """Drop a view or a table, whichever the name is, with all its versions; returns its kind, or None if there is neither."""
    kind = relation_kind(spark, name)
    if kind is None:
        return None
    spark.sql(f"DROP {'TABLE' if kind == 'plain table' else 'VIEW'} IF EXISTS {_identifier(name)}")
    if kind == "table":
        database, table = database_and_table(spark, name)
        for version in _versions(spark, database).get(table.lower(), []):
            _drop_version(spark, database, version)
    return kind.removeprefix("plain ")
