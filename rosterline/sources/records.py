"""Records of large CSV files, found by many tasks although line breaks may stand inside quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from rosterline.session import fresh_path

PLACE = ["file", "block"]
MOST_BROADCAST = 100_000  # blocks; beyond, they are joined by exchange


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with their file, the byte range they begin in, and a number that grows within the range."""
    lines = spark.read.option("lineSep", "\n").text(path)
    metadata = F.col("_metadata")
    return lines.select(
        "value", metadata["file_path"].alias("file"), metadata["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id")
    )


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"')))


def _well_quoted(record: Column) -> Column:
    """Whether every cell is quoted as a whole or holds no quote, so that quotes tell where records end.

    Without doubled quotes, quotes part the text by turns into what is outside and inside cells. All that is outside
    must begin and end at a comma, but for the two ends of the record.
    """
    parts = F.split(F.replace(record, F.lit('""')), '"')
    last = F.size(parts) - 1

    def good(part: Column, at: Column) -> Column:
        starts = (at == 0) | part.startswith(",") | ((at == last) & (part == ""))
        ends = (at == last) | part.endswith(",") | ((at == 0) & (part == ""))
        return (at % 2 == 1) | (starts & ends)

    turns = F.transform(parts, good)
    return ~F.contains(record, F.lit('"')) | ((F.size(parts) % 2 == 1) & F.forall(turns, lambda each: each))


def _blocks(lines: DataFrame) -> DataFrame:
    """Per byte range: lines and odd lines, that is with an odd number of quotes, and whether its file is of a plain kind."""
    value = F.col("value")
    return lines.groupBy(*PLACE).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(_quotes(value) % 2).cast("long").alias("odd"),
        F.count_if(value.endswith("\r")).alias("with_cr"),
        F.count_if(F.contains(F.regexp_replace(value, "\r$", ""), F.lit("\r"))).alias("inner_cr"),
        F.max_by(~value.endswith("\r"), "id").alias("last_without_cr"),
        F.min_by(value, "id").alias("first_line"),
        F.count_if(~_well_quoted(F.regexp_replace(value, "\r$", "")) & (_quotes(value) % 2 == 0)).alias("bad_alone"),
    )


def split_records(spark: SparkSession, path: str) -> DataFrame | None:
    """One row per record of the CSV files but their headers, or None where quotes do not tell where records end.

    A line begins inside a quoted cell if an odd number of quotes stands before it. Each byte range counts its own, the
    counts of the ranges before it are summed, and so every range knows how it begins. Ranges in which no cell
    goes over a line are records line by line and are not exchanged; in the others, and the first of each file, lines
    are put together per range, and the records that go from one range into the next, one row per range, by the
    range they begin in. The order of records is not kept.

    None stands for files that are read in one task instead: with quotes inside unquoted cells or open at the
    end, mixed line ends, or an empty line at the start.
    """
    lines = _lines(spark, path)
    kept = fresh_path(spark, "blocks")
    _blocks(lines).write.parquet(kept)
    blocks = spark.read.parquet(kept)
    in_file = Window.partitionBy("file").orderBy("block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({
        "inside": F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2,
        "owner": F.last(F.when(F.col("odd") > 0, F.col("block")), ignorenulls=True).over(earlier),
        "is_last": F.lead("block").over(in_file).isNull(),
    }).withColumn("open", (F.col("inside") + F.col("odd")) % 2)
    tangled = (F.col("odd") > 0) | (F.col("inside") == 1) | (F.col("block") == 0)
    facts = blocks.agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("lines").alias("lines"), F.sum("with_cr").alias("with_cr"), F.sum("inner_cr").alias("inner_cr"),
        F.count_if(F.col("is_last") & F.col("last_without_cr")).alias("ends_without_cr"),
        F.count_if(F.col("is_last") & (F.col("open") == 1)).alias("left_open"),
        F.count_if((F.col("block") == 0) & F.col("first_line").rlike("^\r?$")).alias("odd_start"),
        F.count_if(~tangled & (F.col("bad_alone") > 0)).alias("bad_alone"),
    ).first()
    with_cr = facts["with_cr"] or 0
    one_kind = not with_cr or with_cr + facts["ends_without_cr"] == facts["lines"]
    if facts["inner_cr"] or not one_kind or facts["left_open"] or facts["odd_start"] or facts["bad_alone"]:
        return None
    blocks = blocks.filter(tangled).select(*PLACE, "inside", "owner", "open")
    if facts["blocks"] <= MOST_BROADCAST:
        blocks = F.broadcast(blocks)
    lines = lines.withColumn("value", F.regexp_replace("value", "\r$", "")) if with_cr else lines
    alone = lines.join(blocks, PLACE, "left_anti").select(F.col("value").alias("record"))

    in_block = Window.partitionBy(*PLACE).orderBy("id")
    before = F.coalesce(F.sum(_quotes(F.col("value")) % 2).over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(blocks, PLACE).withColumn("starts", ((F.col("inside") + before) % 2 == 0).cast("int"))
    numbered = placed.withColumn("number", F.sum("starts").over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "value"))), lambda each: each["value"]), "\n")
    pieces = numbered.groupBy(*PLACE, "number", "inside", "owner", "open").agg(text.alias("record"))
    last = F.col("number") == F.max("number").over(Window.partitionBy(*PLACE))
    pieces = pieces.withColumn("crosses", (F.col("number") == 0) | ((F.col("open") == 1) & last))
    pieces = pieces.withColumn("begins_in", F.when(F.col("number") == 0, F.col("owner")).otherwise(F.col("block")))
    pieces = pieces.withColumn("is_header", (F.col("block") == 0) & (F.col("number") == 1))
    kept = fresh_path(spark, "records")
    pieces.select("file", "block", "begins_in", "crosses", "is_header", "record").write.parquet(kept)
    pieces = spark.read.parquet(kept)
    whole = pieces.filter(~F.col("crosses")).select("is_header", "record")
    joined = pieces.filter("crosses").groupBy("file", "begins_in").agg(
        F.bool_or("is_header").alias("is_header"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda each: each["record"]), "\n").alias("record"),
    )
    put_together = whole.unionByName(joined.select("is_header", "record"))
    if put_together.filter(~_well_quoted(F.col("record"))).limit(1).count():
        return None
    return alone.unionByName(put_together.filter(~F.col("is_header")).select("record")).filter("record <> ''")
