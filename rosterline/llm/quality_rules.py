"""Quality rules whose limits come from quantile sketches of each language and source."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterline.llm.common import coarse, column_function, group_key, staged

WINDOW = 8
SYMBOLS = frozenset("#*$%&|<>")
MEASURES = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long>"

# Per rule: the value as a whole number, how many spreads beyond the quartiles it may lie, what is counted in it and
# how many of these one event makes up, and whether a low value fails too.
RULES = {
    "word_length": ("1000 * m.word_chars div greatest(m.n_words, 1L)", 8, None, True),
    "symbols": ("1000 * m.n_symbols div greatest(m.word_chars, 1L)", 3, ("word_chars", 5), False),
    "dup_lines": ("1000 * m.n_dup_lines div greatest(m.n_words, 1L)", 3, ("n_words", 3), False),
    "repeats": ("1000 * m.n_repeat_words div greatest(m.n_words, 1L)", 3, ("n_words", 2 * WINDOW), False),
}


def measure_text(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, and words in windows that occur again."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    symbols = sum(text.count(each) for each in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    repeated = 0
    if len(words) > WINDOW:
        seen = Counter(zip(*(words[i:] for i in range(WINDOW))))
        if len(seen) < len(words) - WINDOW + 1:
            covered = -1  # the last position counted so far
            for at, window in enumerate(zip(*(words[i:] for i in range(WINDOW)))):
                if seen[window] > 1:
                    repeated += at + WINDOW - 1 - max(covered, at - 1)
                    covered = at + WINDOW - 1
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


@column_function(MEASURES)
def measures(texts: pd.Series) -> pd.DataFrame:
    rows = [measure_text(text) for text in texts]
    return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def thresholds(measured: DataFrame) -> DataFrame:
    """Per language and source (as ``lang_key``, ``source_key``) the lowest and highest value that passes each rule.

    A sketch is a count per bin (see ``common.coarse``): sketches merge by adding counts, whatever the order, so
    reruns agree. Limits lie some spreads beyond the quartiles of the group's own sketch, however few its rows. Its
    spread is the distance of the quartiles, a bin's width at least, and wider the fewer rows they are known from. Of
    what most texts have none, it is at least what one event makes up in a text of the group's median size: a
    share that chance alone brings about. So every limit comes from the group, and no other changes it.
    """
    sized = {size[0]: f"m.{size[0]}" for _, _, size, _ in RULES.values() if size}
    read = {**{name: sql for name, (sql, *_) in RULES.items()}, **sized}
    values = F.array(*[F.struct(F.lit(name).alias("rule"), F.expr(sql).alias("value")) for name, sql in read.items()])
    bins = (
        measured.filter("not base_failed").select("lang_key", "source_key", F.explode(values).alias("v"))
        .select("lang_key", "source_key", "v.rule", F.expr(coarse("v.value")).alias("bin"))
        .groupBy("lang_key", "source_key", "rule", "bin").agg(F.count("*").alias("rows"))
    )
    group = Window.partitionBy("lang_key", "source_key", "rule")
    ranked = bins.withColumn("upto", F.sum("rows").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("total", F.sum("rows").over(group))
    quartiles = ranked.groupBy("lang_key", "source_key", "rule").agg(F.max("total").alias("total"), *[
        F.min(F.when(F.expr(f"4 * upto >= {part} * total"), F.col("bin"))).alias(name) for part, name in ((1, "low"), (2, "middle"), (3, "high"))
    ])
    found = quartiles.groupBy("lang_key", "source_key").agg(*[
        F.max(F.when(F.col("rule") == name, F.struct("low", "middle", "high", "total"))).alias(name) for name in read
    ])
    columns = []
    for name, (_, reach, size, _) in RULES.items():
        of = F.col(name)
        width = F.expr(f"shiftleft(1L, greatest(0, length(bin({name}.high)) - 7))")
        spread = F.greatest(of["high"] - of["low"], width) * (1 + 2 / F.sqrt(of["total"]))
        if size:
            spread = F.greatest(spread, F.lit(1000 * size[1]) / F.greatest(F.col(size[0])["middle"], F.lit(1)))
        columns.append((of["high"] + F.floor(reach * spread)).alias(f"{name}_most"))
        columns.append((of["low"] - F.floor(reach * spread)).alias(f"{name}_least"))
    return found.select("lang_key", "source_key", *columns)


def quality_rules(docs: DataFrame, keep_row: bool = False) -> DataFrame:
    """Judge every document: doc_id, the measures, base_failed and kept; with ``keep_row`` also the row as ``row``.

    Texts that are null or empty have no words and fail. A null language or source is a group of its own.
    Repeated rows are judged alike. An empty table gives no rows. Other columns are not looked at.
    """
    narrow = [F.col("doc_id"), group_key("lang").alias("lang_key"), group_key("source").alias("source_key")]
    if keep_row:
        narrow.append(F.struct(*[docs[name] for name in docs.columns]).alias("row"))
    failed = F.expr("m.n_words < 20 or 100 * m.n_repeat_words > 30 * m.n_words")
    measured = docs.select(*narrow, measures(F.col("text")).alias("m")).withColumn("base_failed", failed)
    measured = staged(measured, "measures")
    limits = staged(thresholds(measured), "limits")
    passes = F.lit(True)
    for name, (sql, *_, low_too) in RULES.items():
        passes = passes & (F.expr(sql) <= F.col(f"{name}_most"))
        if low_too:
            passes = passes & (F.expr(sql) >= F.col(f"{name}_least"))
    judged = measured.join(limits, ["lang_key", "source_key"], "left")
    return judged.select(
        "doc_id", "m.*", "base_failed", (~F.col("base_failed") & F.coalesce(passes, F.lit(False))).alias("kept"),
        *(["row"] if keep_row else []),
    )
