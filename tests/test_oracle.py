from __future__ import annotations

import pytest

import __spark_entry__ as contract
from hearthtab.plans.queries import QUERIES as OWN_QUERIES
from tests.compare import connect, duck_types, oracle_rows, spark_rows

# The training-data queries have tests of their own.
QUERIES = {name: contract.queries()[name] for name in OWN_QUERIES}
ORACLES = {name: sql for name, sql in contract.oracle_sql().items() if name in OWN_QUERIES}
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN"}
# At the smallest scale these tables can be empty.
MAY_BE_EMPTY = {
    "rent_burden_by_city", "low_income_rent_burden", "rent_per_family_bands", "ppbr_by_rent_burden",
}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_oracle(spark, con, small, name):
    df = QUERIES[name](spark, small)
    got, expected = spark_rows(df), oracle_rows(con, ORACLES[name])
    assert got == expected
    assert got[1] or name in MAY_BE_EMPTY
    types = {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema.fields}
    assert types == duck_types(con, ORACLES[name])


def test_entry(spark):
    table = contract.entry(spark)
    assert table.columns == ["is_multifam", "YEAR", "weighted_count", "count", "percent"]
    assert table.count() > 0
