"""Time the main queries; prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores. The session is the shipped one, with as many
shuffle partitions as cores. Each query runs once to warm up and then three times, and counts with its median.
``stage_inputs``, the one-off derivation of the report inputs, runs once, cold, and is not in the total; nor is what
is there to compare with: the headline report in its plain form, read back from a saved table, and merged from stored
parts, with the time to refresh the part of one fact. ``duckdb_ratio`` has Spark's time over that of the same SQL in
DuckDB, in this process on as many threads, which derives the report inputs within each query.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from rosterline.plans import parts, reports
from rosterline.session import fresh_path, get_session, workspace
from verification.compare import oracle
from verification.fixtures import inputs, report_tables
from verification.oracles import all_sql
from verification.registry import QUERIES

HEADLINE = (
    "report_grain5_d15", "report_grain5_d13", "report_grain4_d8", "report_grain4_d2", "report_v4", "report_v3", "report_v2",
    "report_v1", "report_weighted", "pdl_rollup", "util_summary_grain5", "key_spine_3_grain5", "spine_join_grain5",
    "lookup_dedup", "cost_lookup", "duplicate_audit", "search_any", "search_counts", "ingest_text",
)
RUNS = 3


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", "bench", **{"spark.driver.memory": "16g", "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    stage = timed(lambda: inputs(spark, sf_dir))

    def run(name: str) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    for name in HEADLINE:
        run(name)
    queries = {name: statistics.median(timed(lambda: run(name)) for _ in range(RUNS)) for name in HEADLINE}

    saved = fresh_path(spark, "report")
    QUERIES["report_grain5_d15"](spark, sf_dir).write.parquet(saved)
    tables, database = report_tables(spark, sf_dir), workspace(spark)
    parts.refresh_parts(spark, database, {name: tables[name] for name in parts.FACTS}, int(cpus))
    compare = {
        "report_grain5_d15_joined": lambda: run("report_grain5_d15_joined"),
        "report_grain5_d15_saved": lambda: spark.read.parquet(saved).write.format("noop").mode("overwrite").save(),
        "report_grain5_d15_parts": lambda: reports.report_grain5_d15({**tables, **parts.part_tables(spark, database)})
        .write.format("noop").mode("overwrite").save(),
        "refresh_one_part": lambda: parts.refresh_parts(spark, database, {"fulfilment": tables["fulfilment"]}, int(cpus)),
    }
    compared = {name: round(statistics.median(timed(action) for _ in range(RUNS)), 3) for name, action in compare.items()}
    con, sql, ratios = oracle(sf_dir), all_sql(), {}
    con.execute(f"SET threads = {int(cpus)}")
    for name in HEADLINE:
        # A table takes all rows without turning them into Python objects.
        action = lambda: con.execute(f"CREATE OR REPLACE TEMP TABLE bench_result AS {sql[name]}")  # noqa: B023, E731
        action()
        ratios[name] = round(queries[name] / statistics.median(timed(action) for _ in range(RUNS)), 2)
    print(json.dumps({
        "metric": "total time of the main queries",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": {name: round(seconds, 3) for name, seconds in queries.items()},
        "compare": compared,
        "duckdb_ratio": ratios,
        "stage_inputs": round(stage, 3),
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
