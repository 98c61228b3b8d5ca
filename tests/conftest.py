from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rosterline.session import get_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = get_session(
        "local[8]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": 8,
            "spark.checkpoint.dir": f"file://{shared}",
            "spark.sql.warehouse.dir": f"file://{tmp_path_factory.mktemp('warehouse')}",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def database(spark):
    from rosterline.session import workspace

    return workspace(spark)


def rows(df):
    """The rows in a fixed order."""
    return sorted((tuple(row) for row in df.collect()), key=lambda row: [(value is None, str(value)) for value in row])
