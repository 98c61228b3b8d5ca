"""The roll-up by delivery lead and parent customer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from rosterline.functions import any_non_null, ist_text, per_unit, whole
from rosterline.operators.grain import GRADE, PRACTICE

KEYS = ("PDL Name", "parent_customer_name")


def pdl_rollup(report: DataFrame, at: dt.datetime | None = None) -> DataFrame:
    """Cost per billed FTE, previous and projected, from the rows of ``report_grain4_d8``.

    FTE is rounded before it divides, so a group with less than half an FTE has no cost per FTE.
    ``at`` is a fixed load time in UTC, for tests.
    """
    stamp = ist_text() if at is None else ist_text(F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz"), source_zone=F.lit("UTC"))
    totals = report.groupBy(*KEYS).agg(
        any_non_null(F.col(PRACTICE)).alias("practice"),
        any_non_null(F.col("project_type")).alias("project_type"),
        any_non_null(F.col(GRADE)).alias("grade"),
        whole(F.sum("prev_mon_actual_billed_fte")).alias("last_bfte"),
        F.sum("prev_total_cost").alias("previous"),
        F.sum("proj_total_cost").alias("projected"),
    )
    costs = totals.withColumns({
        "prev_cost_per_bfte": per_unit(F.col("previous"), F.col("last_bfte")),
        "projected_cost_per_bfte": per_unit(F.col("projected"), F.col("last_bfte")),
    })
    return order_rollup(costs.select(
        *KEYS, "practice", "project_type", "grade", "last_bfte", "prev_cost_per_bfte", "projected_cost_per_bfte",
        (F.col("projected_cost_per_bfte") - F.col("prev_cost_per_bfte")).alias("diff"),
        stamp.alias("load_date"),
    ))


def order_rollup(df: DataFrame) -> DataFrame:
    return df.orderBy(*[F.asc_nulls_last(key) for key in KEYS])
