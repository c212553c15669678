"""Stage tables by household: no shuffle in rollup and merge."""

from __future__ import annotations

import pytest

from hearthtab.operators.household import household_rollup, join_household
from hearthtab.operators.skew import NONE_HEAVY, SkewLimits
from hearthtab.plans import colocated, queries
from tests.compare import spark_rows


@pytest.fixture(scope="module")
def stored(spark, small, tmp_path_factory):
    found = colocated.store_households(
        queries.numbered_person(spark, small), str(tmp_path_factory.mktemp("colocated")), buckets=3
    )
    yield found
    for name in (found.person_name, found.household_name):
        spark.sql(f"DROP TABLE {name}")


def _executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_rollup_and_merge_shuffle_nothing(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rolled = _executed(household_rollup(stored.person))
        merged = _executed(join_household(stored.person, stored.household, NONE_HEAVY))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rolled.count("Exchange") == 0 and rolled.count("FileScan parquet") == 1
    assert merged.count("Exchange") == 0 and merged.count("FileScan parquet") == 2


def test_tables_equal_the_direct_plans(spark, small, stored):
    household = queries.household(spark, small)
    assert spark_rows(stored.household.select(*household.columns)) == spark_rows(household)
    merged = queries.with_household(spark, small)
    assert spark_rows(stored.person_with_household.select(*merged.columns)) == spark_rows(merged)


def test_one_file_per_bucket(stored):
    for table in (stored.person, stored.household):
        assert len(table.inputFiles()) == 3


def test_heavy_households_are_dealt(spark, small, tmp_path):
    person, _ = queries._hot_person(spark, small)
    found = colocated.store_households(person, str(tmp_path), buckets=3, limits=SkewLimits(1000))
    want = queries._merged_columns(queries.QUERIES["person_with_household_hot"](spark, small))
    assert spark_rows(queries._merged_columns(found.person_with_household)) == spark_rows(want)


def test_empty_table(spark, small, tmp_path):
    found = colocated.store_households(
        queries.numbered_person(spark, small).where("false"), str(tmp_path), buckets=2
    )
    assert found.person_with_household.collect() == []
