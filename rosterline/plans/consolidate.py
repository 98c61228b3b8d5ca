"""Facts brought together: one row per key with the measures and descriptions of every source.

There are two forms with the same result. ``one_shuffle`` unions the narrowed facts and groups them
once, so each fact is read once, and the one exchange carries a partial row per key and task; a hot key
is no larger there than any other. A description travels as a (rank, value) struct, or if it is text, as one
text that begins with the rank, which takes half the memory; NULL where the value is: its least is a value of
the best-ranked source that has one, so one column does the work of one per source. The facts may be given as stored parts, one row per key already (see ``plans.parts``): these are
merged instead of aggregated, and as they lie in buckets of one column, without an exchange. ``joined`` summarises each fact, builds the key spine and joins the
summaries to it; it is the plain reading of the report and the check on the first form.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from rosterline.operators.grain import Source, attach, spine, summarise, to_grain
from rosterline.operators.headers import column, pick

Tables = Mapping[str, DataFrame]
MOST_CHARACTERS = (1 << 31) - 2
KEY_HASH = "__key_hash"  # in a part: the column its rows are bucketed by


@dataclass(frozen=True)
class Layout:
    """What to bring together.

    ``spine`` are the sources that contribute keys, in order of preference. ``measures`` names what to
    compute from which source. ``attributes`` lists per description the sources to take it from, the preferred first.
    """

    grain: Sequence[str]
    spine: Sequence[Source]
    measures: Mapping[str, Source]
    attributes: Mapping[str, Sequence[tuple[Source, str]]]

    @property
    def sources(self) -> list[Source]:
        every = [*self.spine, *self.measures.values()]
        return [source for i, source in enumerate(every) if source not in every[:i]]

    def owned(self, source: Source) -> bool:
        """Whether the source is the spine by itself, so that its rows need no match."""
        return len(self.spine) == 1 and source == self.spine[0]


def is_part(df: DataFrame) -> bool:
    return KEY_HASH in df.columns


def _rank(number: int) -> str:
    return chr(ord("0") + number)


def _present(source: Source) -> str:
    return f"has_{source.table}"


def carriers(layout: Layout) -> dict[str, str]:
    """Per description, the one that carries it: itself, or one that starts with the same sources and has more."""

    def starts_with(longer: str, shorter: str) -> bool:
        choices = list(layout.attributes[shorter])
        return list(layout.attributes[longer])[: len(choices)] == choices

    by_length = sorted(layout.attributes, key=lambda name: -len(layout.attributes[name]))
    return {name: next(other for other in by_length if starts_with(other, name)) for name in layout.attributes}


def _one_shuffle(tables: Tables, layout: Layout) -> DataFrame:
    measures = {name: source.measures[name] for name, source in layout.measures.items()}
    carrier = carriers(layout)
    carried = {name: layout.attributes[name] for name in carrier.values()}
    bits = {source.table: 1 << i for i, source in enumerate(layout.spine)}
    given = [is_part(tables[source.table]) for source in layout.sources]
    if any(given) != all(given):
        raise ValueError("either all facts are given as parts, or none")
    parts = all(given)

    def is_text(source: Source, attribute: str) -> bool:
        df = tables[source.table]
        value = column(df, attribute) if parts else pick(df, *source.attributes[attribute])
        return isinstance(df.select(value).schema[0].dataType, StringType)

    texts = {name for name, choices in carried.items() if len(choices) <= 9 and all(is_text(*choice) for choice in choices)}

    def narrowed(source: Source) -> DataFrame:
        df = tables[source.table]
        columns = [F.col(KEY_HASH), *[column(df, key) for key in layout.grain]] if parts else source.key_columns(df, layout.grain)
        if source in layout.spine:
            columns.append(F.lit(bits[source.table]).alias("__present"))
        own = [name for name, owner in layout.measures.items() if owner == source]
        columns += [(F.col(name) if parts else measures[name].input(df)).alias(name) for name in own]
        for name, choices in carried.items():
            for rank, (owner, attribute) in enumerate(choices):
                if owner == source:
                    value = column(df, attribute) if parts else pick(df, *source.attributes[attribute])
                    if name in texts:
                        columns.append(F.concat(F.lit(_rank(rank)), value).alias(name))
                    else:
                        ranked = F.struct(F.lit(rank).cast("byte").alias("rank"), value.alias("value"))
                        columns.append(F.when(value.isNotNull(), ranked).alias(name))
        return df.select(*columns)

    def together(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.unionByName(right, allowMissingColumns=True)

    facts = reduce(together, [narrowed(source) for source in layout.sources])
    keys = [column(facts, key) for key in layout.grain]
    # Least values of text are aggregated in key order; with one number first, sorting seldom compares texts.
    keyed = facts.groupBy(F.col(KEY_HASH) if parts else F.xxhash64(*keys).alias(KEY_HASH), *keys).agg(
        F.bit_or("__present").alias("__present"),
        *[(F.sum(name) if parts else measures[name].over(F.col(name))).alias(name) for name in measures],
        *[F.min(name).alias(name) for name in carried],
    )
    keyed = keyed.filter(F.col("__present").isNotNull())

    # A key with a NULL in it is on the spine but matches no summary.
    matched = reduce(and_, [column(keyed, key).isNotNull() for key in layout.grain])

    def if_matched(source: Source | None, col: Column) -> Column:
        return col if source is not None and layout.owned(source) else F.when(matched, col)

    def is_present(source: Source) -> Column:
        present = if_matched(source, F.col("__present").bitwiseAND(bits[source.table]) != 0)
        return F.coalesce(present, F.lit(False)).alias(_present(source))

    def description(name: str) -> Column:
        best, choices = F.col(carrier[name]), layout.attributes[name]
        if carrier[name] in texts:
            value, is_own = F.substring(best, 2, MOST_CHARACTERS), best < _rank(len(choices))
        else:
            value, is_own = best["value"], best["rank"] < len(choices)
        value = value if carrier[name] == name else F.when(is_own, value)
        return if_matched(layout.spine[0] if len(layout.spine) == 1 else None, value).alias(name)

    return keyed.select(
        *[column(keyed, key) for key in layout.grain],
        *[is_present(source) for source in layout.spine],
        *[if_matched(source, F.col(name)).alias(name) for name, source in layout.measures.items()],
        *[description(name) for name in layout.attributes],
    )


def _joined(tables: Tables, layout: Layout) -> DataFrame:
    def own(source: Source, name: str) -> str:
        return f"{source.table}.{name}"

    def summary(source: Source) -> DataFrame:
        measures = [name for name, owner in layout.measures.items() if owner == source]
        wanted = sorted({name for choices in layout.attributes.values() for owner, name in choices if owner == source})
        if measures or wanted:
            df = summarise(tables[source.table], source, layout.grain, measures, wanted)
        else:
            df = to_grain(tables[source.table], source, layout.grain).distinct()
        renamed = df.withColumnsRenamed({name: own(source, name) for name in wanted})
        return renamed.withColumn(_present(source), F.lit(True)) if source in layout.spine else renamed

    summaries = {source.table: summary(source) for source in layout.sources}
    if len(layout.spine) == 1:
        base = summaries[layout.spine[0].table]
    else:
        base = spine([summaries[source.table] for source in layout.spine], layout.grain)
    for source in layout.sources:
        if not layout.owned(source):
            base = attach(base, summaries[source.table], layout.grain)
    return base.select(
        *[column(base, key) for key in layout.grain],
        *[F.coalesce(F.col(_present(source)), F.lit(False)).alias(_present(source)) for source in layout.spine],
        *[F.col(name) for name in layout.measures],
        *[
            F.coalesce(*[column(base, own(owner, attribute)) for owner, attribute in choices]).alias(name)
            for name, choices in layout.attributes.items()
        ],
    )


FORMS = {"one_shuffle": _one_shuffle, "joined": _joined}


def consolidate(tables: Tables, layout: Layout, form: str = "one_shuffle") -> DataFrame:
    """The keys of the spine, ``has_<table>`` per spine source, the measures and the descriptions.

    Sums are NULL, and counts are NULL or 0, where the source has no row for the key.
    """
    return FORMS[form](tables, layout)


def has(source: Source) -> Column:
    return F.col(_present(source))
