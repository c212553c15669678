from __future__ import annotations

import re
from decimal import Decimal

import pytest

from hearthtab.functions.recode import recode_person
from hearthtab.operators import components, rent
from hearthtab.operators.household import (
    HOUSEHOLD_COLUMNS,
    household_rollup,
    join_household,
    reference_persons,
)
from hearthtab.operators.skew import NONE_HEAVY, SkewLimits, find_heavy
from hearthtab.operators.validate import (
    ValidationError,
    distinct_count,
    validate_row_counts,
    validate_unique_key,
)
from hearthtab.plans import fixture, queries
from tests.compare import spark_rows

SCHEMA = (
    "YEAR int, SERIAL bigint, PERNUM int, NUMPREC int, room int, bedroom int, GQ int, "
    "HHWT decimal(12,2), n_multifam int, is_multifam boolean, "
    "inctot_harmonized decimal(16,3), AGE int, RELATE int"
)


def person_rows(spark):
    def row(year, serial, pernum, age, relate, income, families=2, multi=True, size=2):
        return (
            year, serial, pernum, size, 4, 2, 1, Decimal(10 * serial), families, multi,
            None if income is None else Decimal(income), age, relate,
        )

    rows = [
        # Same serial in two years; incomes all missing in the second.
        row(2000, 1, 2, 30, 2, "0.125"),
        row(2000, 1, 1, 40, 1, "100.250"),
        row(2010, 1, 1, 40, 1, None, families=0, multi=None, size=1),
        # Every relationship code, and a person whose family count is higher.
        *[row(2000, 2, k, 17 + k % 2, k, None, families=1 + k // 13, size=13) for k in range(1, 14)],
        # No relationship known.
        row(2000, 3, 1, None, None, "-5", size=1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_rollup(spark):
    got = {(r.YEAR, r.SERIAL): r for r in household_rollup(person_rows(spark)).collect()}
    assert len(got) == 4
    first = got[2000, 1]
    assert (first.hh_size, first.NUMPREC, first.hhinc_harmonized) == (2, 2, 100.375)
    assert (first.n_adults, first.n_children, first.n_spouse) == (2, 0, 1)
    assert first.is_multifam is True and first.HHWT == Decimal(10)

    missing = got[2010, 1]
    assert missing.hhinc_harmonized is None and missing.is_multifam is None

    every = got[2000, 2]
    assert (every.n_spouse, every.n_child, every.n_parent, every.n_grandchild) == (1, 1, 2, 1)
    assert (every.n_other_rel, every.n_non_rel) == (4, 2)
    assert every.n_adults + every.n_children == 13
    assert every.n_multifam == 2

    unknown = got[2000, 3]
    assert unknown.n_spouse is None and unknown.n_adults is None
    assert unknown.hhinc_harmonized == -5.0


def test_join_keeps_persons_and_suffixes_shared_columns(spark):
    person = person_rows(spark)
    merged = join_household(person, household_rollup(person), NONE_HEAVY)
    assert merged.count() == person.count()
    for name in ("NUMPREC", "room", "bedroom", "GQ", "HHWT", "n_multifam", "is_multifam"):
        assert name in merged.columns and f"{name}_hh" in merged.columns
    assert "hh_size_hh" not in merged.columns


def test_join_with_heavy_households_gives_the_same_rows(spark):
    person = person_rows(spark)
    rolled = household_rollup(person)
    heavy = find_heavy(person, ["YEAR", "SERIAL"], SkewLimits(rows_per_task=2))
    assert [(row.YEAR, row.SERIAL) for row in heavy.table.collect()] == [(2000, 2)]
    plain = join_household(person, rolled, NONE_HEAVY)
    salted = join_household(person, rolled, heavy)
    assert spark_rows(salted) == spark_rows(plain)
    assert "explode" in salted._jdf.queryExecution().optimizedPlan().toString()


def test_reference_persons_equal_the_join(spark, small):
    person = queries.numbered_person(spark, small)
    joined = rent.model_population(join_household(person, household_rollup(person), NONE_HEAVY))
    direct = recode_person(rent.model_population(reference_persons(person)))
    assert set(direct.columns) == set(joined.columns)
    assert spark_rows(direct) == spark_rows(joined.select(*direct.columns))


def test_merge_shares_one_shuffle_of_the_persons(spark, small):
    """Numbering, rollup and merge use one layout: the lines are shuffled once."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = queries.with_household(spark, small)
        merged.collect()
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan.split("== Initial Plan ==")[0]
    shuffles = re.findall(r"[+:]- Exchange hashpartitioning", final)
    assert len(shuffles) == 2  # lines and orders
    reused = [line for line in final.splitlines() if "ReusedExchange" in line]
    assert len([line for line in reused if "BroadcastExchange" not in line]) == 2


def test_sizes_agree(spark, small):
    rolled = queries.household(spark, small)
    assert rolled.where("hh_size <> NUMPREC OR hh_size <> n_adults + n_children").isEmpty()
    assert len(rolled.columns) == 2 + len(HOUSEHOLD_COLUMNS) == 19


def test_validation(spark):
    person = person_rows(spark)
    assert validate_row_counts(person, 17, "recode") == 17
    assert distinct_count(person, ["YEAR", "SERIAL"]) == 4
    with pytest.raises(ValidationError, match="merge: expected 16 rows, found 17"):
        validate_row_counts(person, 16, "merge")
    validate_unique_key(person, ["YEAR", "SERIAL", "PERNUM"], "recode")
    with pytest.raises(ValidationError, match="not unique"):
        validate_unique_key(person, ["YEAR", "SERIAL"], "recode")


def test_components_in_one_pass_equal_one_table_each(spark, small):
    rolled = queries.household(spark, small)
    wide = {row.YEAR: row for row in components.hh_components(rolled).collect()}
    for name in components.COMPONENTS:
        for row in components.get_component_mean(rolled, name).collect():
            assert wide[row.YEAR][name] == row[name]


def test_fixture_columns(spark, small):
    person = fixture.person(spark, small)
    assert tuple(person.columns) == fixture.PERSON_COLUMNS
    validate_unique_key(person, ["YEAR", "SERIAL", "PERNUM"], "fixture")
    few = fixture.person(spark, small, ["YEAR", "AGE", "PERWT"])
    assert spark_rows(few) == spark_rows(person.select("YEAR", "AGE", "PERWT"))
