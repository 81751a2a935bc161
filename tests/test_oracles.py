"""Every registered query at the smallest scale, against its SQL twin where it has one."""

import pytest

import __spark_entry__ as contract
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, name):
    _, verdict = compare(spark, SF, name, contract.queries()[name], contract.oracle_sql().get(name))
    assert verdict in ("ok", "rows only"), verdict
