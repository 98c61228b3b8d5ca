"""Run registered queries in Spark and in DuckDB and compare the rows.

    python -m verification.compare [data folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

from rosterline.session import get_session
from verification.oracles import all_sql
from verification.registry import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    return value + 0.0 if isinstance(value, float) else value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def difference(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str, sql: str) -> tuple[int, str]:
    """Number of Spark rows, and what differs: empty when nothing does."""
    df = QUERIES[name](spark, sf_dir)
    got = _bag(df.columns, (tuple(row) for row in df.collect()))
    cursor = con.execute(sql)
    names = [each[0] for each in cursor.description]
    if sorted(names) != sorted(df.columns):
        return sum(got.values()), f"columns {sorted(df.columns)} against {sorted(names)}"
    want = _bag(names, cursor.fetchall())
    if got == want:
        return sum(got.values()), ""
    extra, lacking = list((got - want).elements()), list((want - got).elements())
    by_text = lambda row: [str(value) for value in row]
    return sum(got.values()), (
        f"{len(extra)} rows only in Spark, {len(lacking)} only in SQL\n"
        f"  {sorted(names)}\n  {sorted(extra, key=by_text)[:2]}\n  {sorted(lacking, key=by_text)[:2]}"
    )


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failures = oracle(sf_dir), all_sql(), 0
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            rows, problem = difference(spark, con, sf_dir, name, sql[name])
        except Exception as error:
            rows, problem = 0, f"{type(error).__name__}: {str(error)[:600]}"
        failures += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {rows} rows {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{failures} of {len(sys.argv[2:] or QUERIES)} differ")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
