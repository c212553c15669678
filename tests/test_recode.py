from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hearthtab.functions.income import INCOME_PARAMETERS, add_harmonized_income
from hearthtab.functions.recode import capped, household_population, in_group_quarters, recode_person


def recoded(spark, column, values, output):
    rows = [(k, value) for k, value in enumerate(values)]
    df = recode_person(spark.createDataFrame(rows, f"k int, {column} int"), allow_missing=True)
    return [row[output] for row in df.orderBy("k").collect()]


@pytest.mark.parametrize(
    ("column", "output", "cases"),
    [
        (
            "NFAMS",
            "n_multifam",
            {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 30: 5, -1: None, None: None},
        ),
        ("NFAMS", "is_multifam", {0: None, 1: False, 2: True, 5: True, 9: True, None: None}),
        ("ROOMS", "room", {0: 0, 1: 1, 8: 8, 9: 9, 10: 9, 30: 9, None: None}),
        (
            "BEDROOMS",
            "bedroom",
            {0: None, 1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 5, 22: 5, None: None},
        ),
        (
            "AGE",
            "age_bucket",
            {
                0: "17 or younger", 17: "17 or younger", 18: "18-29", 29: "18-29", 30: "30-49",
                49: "30-49", 50: "50-65", 64: "50-65", 65: "65 and older", 95: "65 and older",
                None: None,
            },
        ),
        (
            "HISPAN",
            "is_hispan",
            {0: False, 1: True, 2: True, 3: True, 4: True, 5: None, 9: None, None: None},
        ),
        (
            "RACE",
            "race_bucket",
            {
                0: None, 1: "white", 2: "black", 3: "aian", 4: "aapi", 5: "aapi", 6: "aapi",
                7: "other", 8: "multi", 9: "multi", 10: None, None: None,
            },
        ),
    ],
)
def test_every_code(spark, column, output, cases):
    assert recoded(spark, column, list(cases), output) == list(cases.values())


def test_hispanic_wins_and_unknown_falls_through(spark):
    rows = [(1, 1), (2, 0), (3, 9), (4, None), (7, 0), (8, 0), (1, 0), (None, 0), (None, 2)]
    df = recode_person(spark.createDataFrame(rows, "RACE int, HISPAN int"), allow_missing=True)
    assert [row.race_eth for row in df.collect()] == [
        "Hispanic", "Black", "AIAN", "AAPI", "Other", "Multiracial", "White", None, "Hispanic",
    ]


def test_persons_per_bedroom(spark):
    rows = [(5, 3), (5, 0), (None, 3)]
    df = recode_person(spark.createDataFrame(rows, "NUMPREC int, BEDROOMS int"), allow_missing=True)
    assert [row.ppbr for row in df.collect()] == [2.5, None, None]


def test_recode_keeps_present_columns_and_skips_missing_inputs(spark):
    df = recode_person(spark.createDataFrame([(7, 3)], "n_multifam int, NFAMS int"), allow_missing=True)
    assert df.columns == ["n_multifam", "NFAMS", "is_multifam"]
    assert df.first().n_multifam == 7


def test_group_quarters_and_household_population(spark):
    df = spark.createDataFrame([(code,) for code in range(7)], "GQ int")
    assert [row.GQ for row in household_population(df).collect()] == [0, 1, 2]
    assert [row.GQ for row in df.where(in_group_quarters(F.col("GQ"))).collect()] == [3, 4, 5, 6]


def test_cap_keeps_null(spark):
    df = spark.createDataFrame([(0,), (7,), (8,), (11,), (None,)], "n int")
    assert [row[0] for row in df.select(capped(F.col("n"), 8)).collect()] == [0, 7, 8, 8, None]


def test_income_in_every_year(spark):
    rows, expected = [], []
    for year, bottom, top, factor in INCOME_PARAMETERS:
        milli = int(factor.replace(".", ""))
        cases = {
            9999999: None,
            9999998: 250000.0,
            bottom - 1: -19998.0,
            bottom: -19998.0,
            bottom + 1: (bottom + 1) * milli / 1000,
            0: 0.0,
            top - 1: (top - 1) * milli / 1000,
            top: 250000.0,
            None: None,
        }
        rows += [(len(rows) + k, year, income) for k, income in enumerate(cases)]
        expected += cases.values()
    rows.append((len(rows), 1950, 1000))
    expected.append(None)
    df = add_harmonized_income(spark.createDataFrame(rows, "k int, YEAR int, INCTOT int"))
    assert df.schema["inctot_harmonized"].dataType.simpleString() == "decimal(16,3)"
    got = [row.inctot_harmonized for row in df.orderBy("k").collect()]
    assert [None if value is None else float(value) for value in got] == expected
    assert len(INCOME_PARAMETERS) == 28


def test_income_thresholds_match_the_common_codes():
    for _, bottom, top, factor in INCOME_PARAMETERS:
        assert abs(bottom * float(factor) + 19998) < 10
        assert abs(top * float(factor) - 250000) < 85


def test_missing_inputs_and_spelling(spark):
    frame = spark.createDataFrame([(2, 9)], "nfams int, ROOMS int")
    with pytest.raises(ValueError, match="the extract has no AGE"):
        recode_person(frame)
    row = recode_person(frame, allow_missing=True).first()
    assert (row.NFAMS, row.n_multifam, row.is_multifam, row.room) == (2, 2, True, 9)
