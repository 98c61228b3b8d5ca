"""The header contract of a table that is being replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


class ContractError(ValueError):
    """The new data lacks columns the live table has."""

    def __init__(self, missing: list[str]):
        super().__init__("missing columns: " + ", ".join(missing))
        self.missing = missing


def check_contract(live: DataFrame, new: DataFrame) -> DataFrame:
    """Each column name of either frame with its state: ``ok``, ``missing`` or ``extra``.

    Names are compared as written, so a change of case is one missing and one extra column.
    """
    spark = live.sparkSession
    required = spark.createDataFrame([(name,) for name in live.columns], "column string")
    offered = spark.createDataFrame([(name,) for name in new.columns], "column string")
    return (
        required.withColumn("required", F.lit(True))
        .join(offered.withColumn("offered", F.lit(True)), "column", "full")
        .select(
            "column",
            F.when(F.col("offered").isNull(), "missing")
            .when(F.col("required").isNull(), "extra")
            .otherwise("ok")
            .alias("state"),
        )
    )
