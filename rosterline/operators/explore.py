"""Search, preview, chart data and free queries."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.window import Window

from rosterline.functions import any_matches, to_number
from rosterline.operators.headers import column
from rosterline.session import fresh_path, remove_path

NO_DATA = "No data found."
MIN_ROWS = 3


def _matches(df: DataFrame, pattern: str) -> Column:
    return any_matches([column(df, name) for name in df.columns], pattern)


def search_any(df: DataFrame, pattern: str | None) -> DataFrame:
    """Rows where any column matches the regex, ignoring case; all rows when there is no pattern."""
    return df.filter(_matches(df, pattern)) if pattern else df


def match_counts(df: DataFrame, pattern: str | None) -> DataFrame:
    """How many rows match, of how many, in one pass."""
    shown = F.count_if(_matches(df, pattern)) if pattern else F.count("*")
    return df.agg(shown.alias("shown"), F.count("*").alias("total"))


def preview_rows(df: DataFrame, order_by: list[Column], n: int = 3, min_rows: int = MIN_ROWS) -> DataFrame:
    """The first ``n`` rows; none when the result is too short to chart."""
    head = df.orderBy(*order_by).limit(max(n, min_rows))  # a few rows, which also say whether there are enough
    numbered = head.select(
        "*", F.row_number().over(Window.orderBy(*order_by)).alias("__at"), F.count("*").over(Window.partitionBy()).alias("__seen")
    )
    return numbered.filter((F.col("__seen") >= min_rows) & (F.col("__at") <= n)).orderBy("__at").drop("__at", "__seen")


def chart_series(df: DataFrame, x: str, y: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """Label and number per point, without the points that lack either; none for a short result.

    The points are computed once, into the shared folder, and counted there.
    """
    points = df.select(column(df, x).cast("string").alias("x"), to_number(column(df, y).cast("string")).alias("y"))
    path = fresh_path(df.sparkSession, "points")
    points.write.parquet(path)
    stored = df.sparkSession.read.schema(points.schema).parquet(path)
    whole = stored.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return whole if len(stored.select("x").take(min_rows)) >= min_rows else whole.limit(0)


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """Any statement in Spark's dialect."""
    return spark.sql(text)


_TASK, _ROW = "__task", "__row"
PRINTED_CHARACTERS = 4_000_000


@dataclass(frozen=True)
class QueryOutcome:
    """What a free query gave: its rows, and a printed form of the first of them or the error.

    The rows are those of the one run that the status is about, kept in the shared folder: reading them, whole or
    by page, does not run the query again. ``discard`` removes them. ``total`` is their number. ``note`` says how many
    of all rows are printed, when that is not all of them.
    """

    status: str
    rows: DataFrame | None
    text: str
    note: str = ""
    total: int = 0
    placed: DataFrame | None = field(default=None, repr=False)
    path: str | None = None

    def page(self, start: int, size: int) -> DataFrame:
        """So many rows from a position on, counted from 0, in the order in which the query gave them.

        Every row is stored with its task and its number there. The counts per task, one small row each, say which
        rows of which tasks make up the page; only those are read.
        """
        if self.placed is None or self.rows is None:
            raise ValueError("a failed query has no pages")
        counts = self.placed.groupBy(_TASK).agg(F.count(F.lit(1)).alias("n"))
        earlier = F.coalesce(F.sum("n").over(Window.orderBy(_TASK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        touched = counts.select(_TASK, "n", earlier.alias("before")).filter((F.col("before") < start + size) & (F.col("before") + F.col("n") > start))
        wanted = F.lit(False)
        for each in touched.collect():  # at most ``size`` of them
            low, high = start - each["before"], start + size - each["before"]
            wanted = wanted | ((F.col(_TASK) == each[_TASK]) & (F.col(_ROW) >= low) & (F.col(_ROW) < high))
        return self.placed.filter(wanted).orderBy(_TASK, _ROW).drop(_TASK, _ROW).toDF(*self.rows.columns)

    def discard(self) -> None:
        """Remove the stored rows."""
        if self.path and self.placed is not None:
            remove_path(self.placed.sparkSession, self.path)


def _storable(df: DataFrame) -> DataFrame:
    """The columns named by position, as names may repeat; those of types that files cannot hold as text."""
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    as_text = {each.name for each in numbered.schema if each.dataType.simpleString() in ("void", "interval")}
    return numbered.withColumns({name: F.col(name).cast("string") for name in as_text}) if as_text else numbered


def query_status(spark: SparkSession, text: str, printed_rows: int = 1000) -> QueryOutcome:
    """Run a query and report ``ok``, ``empty`` or ``error``.

    The query runs once: its rows are written to the shared folder and counted as they are written, and what is
    printed is read from there. Only the printed form reaches the driver, of ``printed_rows`` rows and
    PRINTED_CHARACTERS at most; the note says when there are more.
    """
    path = fresh_path(spark, "result")
    try:
        df = spark.sql(text)
        counted = Observation()
        row = F.monotonically_increasing_id()
        placed = _storable(df).select("*", F.shiftright(row, 33).alias(_TASK), row.bitwiseAND((1 << 33) - 1).alias(_ROW))
        placed.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        stored = spark.read.schema(placed.schema).parquet(path)
        total = counted.get["rows"]
        outcome = QueryOutcome("ok", stored.drop(_TASK, _ROW).toDF(*df.columns), "", "", total, stored, path)
        if not total:
            return replace(outcome, status="empty", text=NO_DATA)
        head = _printable(outcome.page(0, printed_rows)).toPandas()
    except Exception as error:  # whatever the query raised is the answer
        remove_path(spark, path)
        return QueryOutcome("error", None, f"Error: {error}")
    note = f"{len(head)} of {total} rows" if total > len(head) else ""
    return replace(outcome, text=head.to_string(index=False), note=note)


def _printable(page: DataFrame) -> DataFrame:
    """The first rows of the page whose text fits; always the first one."""
    names = page.columns
    numbered = page.toDF(*[f"c{i}" for i in range(len(names))]).select("*", F.monotonically_increasing_id().alias(_ROW))
    width = F.length(F.to_json(F.struct(*[f"c{i}" for i in range(len(names))]))) if names else F.lit(0)
    so_far = F.sum(width).over(Window.orderBy(_ROW))  # over one page
    kept = numbered.select("*", so_far.alias("__width")).filter((F.col("__width") <= PRINTED_CHARACTERS) | (F.col(_ROW) == 0))
    return kept.orderBy(_ROW).drop(_ROW, "__width").toDF(*names)
