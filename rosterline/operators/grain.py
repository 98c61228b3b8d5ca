"""Facts at a common key grain: alignment, summaries and key spines."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rosterline.functions import any_non_null, headcount, sum_text, to_number
from rosterline.operators.headers import column, pick

PROJECT, PRACTICE, LOCATION, GRADE, DEPARTMENT = "Project Id", "Practice", "Location", "Grade", "department_name"
GRAIN_4 = (PROJECT, PRACTICE, LOCATION, GRADE)
GRAIN_5 = (*GRAIN_4, DEPARTMENT)

Headers = tuple[str, ...]


@dataclass(frozen=True)
class Measure:
    """One number per key: the ``sum`` of a text column, its ``count``, or the number of ``rows``."""

    kind: str
    headers: Headers = ()

    def input(self, df: DataFrame) -> Column:
        if self.kind == "rows":
            return F.lit(1)
        value = pick(df, *self.headers)
        return to_number(value) if self.kind == "sum" else value

    def over(self, col: Column) -> Column:
        """The aggregate over a column made by ``input``."""
        return F.sum(col) if self.kind == "sum" else F.count(col)

    def aggregate(self, df: DataFrame) -> Column:
        if self.kind == "rows":
            return F.count("*")
        value = pick(df, *self.headers)
        return sum_text(value) if self.kind == "sum" else headcount(value)


@dataclass(frozen=True)
class Source:
    """How a fact table names the shared keys, its measures and its descriptions."""

    table: str
    keys: Mapping[str, Headers]
    measures: Mapping[str, Measure] = field(default_factory=dict)
    attributes: Mapping[str, Headers] = field(default_factory=dict)

    def key_columns(self, df: DataFrame, grain: Sequence[str]) -> list[Column]:
        return [pick(df, *self.keys[key]).alias(key) for key in grain]


def to_grain(df: DataFrame, source: Source, grain: Sequence[str], *values: str) -> DataFrame:
    """Select the keys under their shared names, and any named measure inputs or attributes."""
    extra = [
        (source.measures[name].input(df) if name in source.measures else pick(df, *source.attributes[name])).alias(name)
        for name in values
    ]
    return df.select(*source.key_columns(df, grain), *extra)


def summarise(
    df: DataFrame,
    source: Source,
    grain: Sequence[str],
    measures: Iterable[str] | None = None,
    attributes: Iterable[str] | None = None,
) -> DataFrame:
    """One row per key with the chosen measures and one value of each chosen attribute."""
    measures = source.measures if measures is None else measures
    attributes = source.attributes if attributes is None else attributes
    return df.groupBy(*source.key_columns(df, grain)).agg(
        *[source.measures[name].aggregate(df).alias(name) for name in measures],
        *[any_non_null(pick(df, *source.attributes[name])).alias(name) for name in attributes],
    )


def spine(frames: Sequence[DataFrame], grain: Sequence[str]) -> DataFrame:
    """The distinct keys of all frames; keys with the same NULLs are one key."""
    keys = [df.select(*[column(df, key) for key in grain]) for df in frames]
    return reduce(DataFrame.unionByName, keys).distinct()


def attach(base: DataFrame, summary: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Left join a summary on its keys; a key that holds a NULL matches nothing."""
    return base.join(summary, on=list(grain), how="left")


def drop_null_key(df: DataFrame, *headers: str) -> DataFrame:
    return df.filter(pick(df, *headers).isNotNull())


def department_map(df: DataFrame, name: Headers, identifier: Headers) -> DataFrame:
    """Department name to one of its ids, from a fact table."""
    return (
        drop_null_key(df, *name)
        .groupBy(pick(df, *name).alias(DEPARTMENT))
        .agg(any_non_null(pick(df, *identifier)).alias("department_id"))
    )
