"""Registered queries: contract, and each of the library's own against its SQL."""

import __spark_entry__ as entry
import check_oracles as O
import pytest

from alamatika.bindings import queries as Q

SF = "/root/testdata/sf0.001"


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 60


@pytest.fixture(scope="module")
def con():
    return O.connect(SF)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, con, name):
    rows, _, _, problem = O.compare(spark, con, SF, name)
    assert rows > 0 and not problem, problem
