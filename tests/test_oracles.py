"""Every registered query against its SQL, over whole tables."""

import pytest

from tests.conftest import MEDIUM
from verification.compare import difference, oracle
from verification.oracles import all_sql
from verification.registry import QUERIES

SQL = all_sql()


@pytest.fixture(scope="module")
def con():
    with oracle(MEDIUM) as connection:
        yield connection


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    count, problem = difference(spark, con, MEDIUM, name, SQL[name])
    assert not problem
    assert count > 0
