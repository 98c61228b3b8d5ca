"""Rows to files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rosterline.session import full_uri, path_exists
from rosterline.sources.workbooks import empty_workbook, save_workbooks, to_workbooks


def export_rows(df: DataFrame, path: str, file_format: str = "csv") -> None:
    """Write the rows to a new folder, as CSV with headers, parquet or xlsx. No rows give an empty export.

    The folder must be one that all executors share.
    """
    if file_format == "xlsx":
        if path_exists(df.sparkSession, path):
            raise FileExistsError(path)
        name, folder = path.rstrip("/").rsplit("/", 1)[-1], full_uri(df.sparkSession, path)
        if not save_workbooks(to_workbooks(df, name), folder):
            save_workbooks(empty_workbook(df.sparkSession, df.columns, name), folder)
        return
    writer = df.write.mode("errorifexists")
    if file_format == "csv":
        writer.csv(path, header=True, quote='"', escape='"', emptyValue='""')
    elif file_format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"cannot export as {file_format!r}")
