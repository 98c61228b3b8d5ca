"""Mix sources to target weights by cutting a random order of each source at its budget."""

from __future__ import annotations

import re
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterline.llm.common import WORD, bucket_bits, column_function, group_key, hash_key, prefix_sums, staged

WEIGHTS = (5, 2, 1)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Add ``target`` to one row per source (source, source_key, source_size).

    The weights go to the sources by code point, null last, over and over. A target stops at ``most`` times
    its source's size and the excess is shared out again by weight, until none is above. That is where a level
    that rises evenly per unit of weight ends: sources that fill up first have the least size per weight, so
    one ordered pass finds the level. The pass is over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(each) for each in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("ratio", F.col("source_size").cast("double") / F.col("weight"))
    fill = Window.orderBy("ratio", F.col("source").isNull(), "source")
    ranked = (
        ranked.withColumn("rank", F.row_number().over(fill))
        .withColumn("full", F.coalesce(F.sum(F.col("source_size") * most).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("left", F.lit(share) * F.col("total") - F.col("full").cast("double"))
    )
    fits = F.col("weight") * F.col("left") / F.col("open") <= F.col("source_size") * most
    everything = Window.partitionBy()
    first = F.min(F.when(fits, F.struct("rank", "left", "open"))).over(everything)
    ranked = ranked.withColumn("first", first)
    target = F.when(
        F.col("first").isNotNull() & (F.col("rank") >= F.col("first.rank")),
        F.col("weight") * F.col("first.left") / F.col("first.open"),
    ).otherwise((F.col("source_size") * most).cast("double"))
    return ranked.select("source_key", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, keep_row: bool = False) -> DataFrame:
    """How much of each document the mix takes: doc_id, size, source_size, target, copies, rest, taken.

    Documents of a source follow each other by a hash of their id (then id and size), as a random order that
    reruns repeat. The source is read in whole epochs (``copies``), and the last epoch is cut at the exact word
    of the budget: the document there gives its first ``rest`` words. Null and empty texts have size 0 and give
    nothing. Rows with the same id are separate documents. A null source is a source of its own.
    """
    columns = ["doc_id", "source", group_key("source").alias("source_key"), word_count().alias("size"), hash_key("doc_id").alias("key")]
    if keep_row:
        columns.append(F.struct(*[docs[name] for name in docs.columns]).alias("row"))
    sized = staged(docs.select(*columns), "sizes")
    sources = sized.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"))
    targets = staged(source_targets(sources, weights, share, most), "targets")
    placed = prefix_sums(sized, "source_key", "key", "size", ["doc_id", "size"], bucket_bits(sized.count()))
    placed = placed.join(targets, "source_key")
    copies = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = F.floor("target").cast("long") - F.col("copies") * F.col("source_size")
    placed = placed.withColumn("copies", copies)
    placed = placed.withColumn("rest", F.least(F.greatest(budget - F.col("before"), F.lit(0)), F.col("size")).cast("long"))
    return placed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("rest")).alias("taken"),
        "copies", "rest", *(["row"] if keep_row else []),
    )


@column_function("string")
def first_words(texts: pd.Series, counts: pd.Series) -> pd.Series:
    """Each text up to the end of the given number of words; null stays null."""
    out = []
    for text, count in zip(texts, counts):
        if text is None:
            out.append(None)
            continue
        ends = (found.end() for found in re.finditer(WORD, text or ""))
        out.append(text[: next(islice(ends, int(count) - 1, None), 0)] if count > 0 else "")
    return pd.Series(out, dtype=object)


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of the documents: whole copies, and the cut document's first words.

    A document without words is in no copy. The cut text ends after its last word taken, ``n_chars`` follows it.
    """
    taken = mix(docs, keep_row=True, **settings).filter("taken > 0")
    whole = F.when(F.col("rest") == F.col("size"), F.col("copies") + 1).otherwise(F.col("copies"))
    times = F.sequence(F.lit(1), whole + F.when((F.col("rest") > 0) & (F.col("rest") < F.col("size")), 1).otherwise(0))
    rows = taken.withColumn("whole", whole).withColumn("copy", F.explode(times))
    # Only the one document at a source's cut is ever shortened; Python gets no other text.
    is_whole = F.col("copy") <= F.col("whole")
    text = F.when(is_whole, F.col("row.text")).otherwise(first_words(F.when(~is_whole, F.col("row.text")), F.col("rest")))
    rows = rows.withColumn("_text", text)
    out = []
    for name in docs.columns:
        if name == "text":
            out.append(F.col("_text").alias("text"))
        elif name == "n_chars":
            out.append(F.when(F.col("copy") <= F.col("whole"), F.col("row.n_chars")).otherwise(F.length("_text")).cast(docs.schema[name].dataType).alias(name))
        else:
            out.append(F.col("row").getField(name).alias(name))
    return rows.select(*out)
