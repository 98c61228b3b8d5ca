"""Finding a column by its workbook header."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def _plain(header: str) -> str:
    return "".join(ch for ch in header.lower() if ch.isalnum())


def quoted(name: str) -> str:
    """The name as an identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def column(df: DataFrame, name: str) -> Column:
    """Column by exact name, also when the name holds dots or blanks."""
    return F.col(quoted(name))


def find_header(df: DataFrame, *headers: str) -> str:
    """Name of the first listed header the frame has.

    Case never matters. A header that differs only in blanks, underscores or dots is taken when there
    is no closer one, so ``Project Id``, ``project_id`` and ``PROJECT ID`` are one column.
    """
    names = df.schema.names
    for same in (str.lower, _plain):
        for header in headers:
            found = [name for name in names if same(name) == same(header)]
            if len(found) == 1:
                return found[0]
            if len(found) > 1:
                raise ValueError(f"header {header!r} is ambiguous: {found}")
    raise ValueError(f"none of the headers {list(headers)} is among {names}")


def pick(df: DataFrame, *headers: str) -> Column:
    return column(df, find_header(df, *headers))


def strip_headers(df: DataFrame) -> DataFrame:
    """Trim blanks around the header names."""
    return df.toDF(*number_repeats([name.strip() for name in df.columns]))


def number_repeats(names: list[str]) -> list[str]:
    """Repeated headers with a number after the first: ``a``, ``a``, ``a`` become ``a``, ``a.1``, ``a.2``."""
    taken, out = set(names), []
    for name in names:
        label, number = name, 0
        while label in out or (number and label in taken):
            number += 1
            label = f"{name}.{number}"
        out.append(label)
    return out


def check_headers(df: DataFrame) -> None:
    """Raise when two headers differ only in case, which a table cannot store."""
    check_names(df.columns)


def check_names(names: Iterable[str]) -> None:
    seen: dict[str, str] = {}
    for name in names:
        if name.lower() in seen:
            raise ValueError(f"headers {seen[name.lower()]!r} and {name!r} differ only in case")
        seen[name.lower()] = name
