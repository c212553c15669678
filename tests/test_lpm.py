from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from hearthtab.operators import lpm
from hearthtab.operators.crosstab import crosstab_mean
from hearthtab.plans import queries

SCHEMA = (
    "YEAR int, race_eth string, is_multifam boolean, PERWT double, n_child int, x double, "
    "age_bucket string"
)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    rows = []
    for year in (2000, 2010):
        # One race is absent in the second year.
        races = ["White", "Black", "Hispanic", "AIAN"] if year == 2000 else ["White", "Black", "AIAN"]
        for _ in range(240):
            age = ["18-29", "30-49", "50-65"][rng.integers(3)]
            rows.append(
                (year, races[rng.integers(len(races))], bool(rng.random() < 0.3),
                 float(rng.integers(1, 50)), int(rng.integers(0, 5)), float(rng.normal(50_000, 20_000)),
                 age)
            )
    return spark.createDataFrame(rows, SCHEMA).cache()


def results(df):
    return {(row.YEAR, row.term): row for row in df.collect()}


def spark_ml(frame, year, text=(), numbers=()):
    """The same regression by the ML library, one year at a time."""
    df = frame.where(F.col("YEAR") == year)
    terms = []
    for column, skip in (("race_eth", 0), *((name, 1) for name in text)):
        levels = sorted(row[0] for row in df.select(column).distinct().collect())[skip:]
        for level in levels:
            terms.append(f"{column}{level}")
            df = df.withColumn(terms[-1], (F.col(column) == level).cast("double"))
    terms += numbers
    df = df.withColumn("label", F.col("is_multifam").cast("double"))
    vectors = VectorAssembler(inputCols=terms, outputCol="features").transform(df)
    model = LinearRegression(
        weightCol="PERWT", fitIntercept=False, solver="normal", standardization=False
    ).fit(vectors)
    summary = model.summary
    return {
        term: values
        for term, *values in zip(
            terms,
            model.coefficients,
            summary.coefficientStandardErrors,
            summary.tValues,
            summary.pValues,
        )
    }


@pytest.mark.parametrize(
    ("text", "numbers"),
    [((), ()), ((), ("n_child",)), (("age_bucket",), ("n_child",)), (("age_bucket",), ("n_child", "x"))],
)
def test_equals_spark_ml(frame, text, numbers):
    got = results(lpm.run_lpm_by_year(frame, [*text, *numbers]))
    for year in (2000, 2010):
        expected = spark_ml(frame, year, text, numbers)
        assert {term for y, term in got if y == year} == set(expected)
        for term, (estimate, error, statistic, p_value) in expected.items():
            row = got[year, term]
            assert row.estimate == pytest.approx(estimate, rel=1e-8, abs=1e-12)
            assert row.std_error == pytest.approx(error, rel=1e-8)
            assert row.statistic == pytest.approx(statistic, rel=1e-7, abs=1e-8)
            assert row.p_value == pytest.approx(p_value, rel=1e-6, abs=1e-12)


def test_without_controls_it_is_the_weighted_mean(frame):
    got = results(lpm.run_lpm_by_year(frame))
    share = frame.withColumn("y", F.col("is_multifam").cast("int"))
    for row in crosstab_mean(share, "y", "PERWT", ["YEAR", "race_eth"]).collect():
        assert got[row.YEAR, f"race_eth{row.race_eth}"].estimate == pytest.approx(row.weighted_mean)


def test_incomplete_rows_and_zero_weights_are_left_out(spark, frame):
    extra = spark.createDataFrame(
        [
            (2000, "White", True, 0.0, 1, 1.0, "18-29"),
            (2000, "White", None, 5.0, 1, 1.0, "18-29"),
            (2000, "White", True, 5.0, None, 1.0, "18-29"),
            (2000, None, True, 5.0, 1, 1.0, "18-29"),
            (2000, "White", True, None, 1, 1.0, "18-29"),
            # Sets the first race of the year, but has no control.
            (2000, "AAPI", True, 5.0, None, 1.0, "18-29"),
        ],
        SCHEMA,
    )
    plain = results(lpm.run_lpm_by_year(frame, ["n_child"]))
    mixed = results(lpm.run_lpm_by_year(frame.union(extra), ["n_child"]))
    assert plain.keys() == mixed.keys()
    for key, row in plain.items():
        assert mixed[key].estimate == pytest.approx(row.estimate)
        assert mixed[key].std_error == pytest.approx(row.std_error)
    assert plain[2000, "n_child"].baseline == "AIAN"
    assert mixed[2000, "n_child"].baseline == "AAPI"


def test_collinear_controls_are_null(frame):
    doubled = frame.withColumn("twice", 2 * F.col("n_child"))
    got = results(lpm.run_lpm_by_year(doubled, ["n_child", "twice"]))
    alone = results(lpm.run_lpm_by_year(frame, ["n_child"]))
    assert got[2000, "twice"].estimate is None and got[2000, "twice"].p_value is None
    assert got[2000, "n_child"].estimate == pytest.approx(alone[2000, "n_child"].estimate)
    assert got[2000, "n_child"].std_error == pytest.approx(alone[2000, "n_child"].std_error)


@pytest.mark.parametrize("mean", [1e3, 1e4, 1e5, 1e6, 1e8])
def test_controls_with_a_large_mean(spark, mean):
    rng = np.random.default_rng(5)
    n = 4000
    race, x, w = rng.integers(0, 3, n), rng.normal(0, 1, n), rng.integers(1, 9, n)
    y = rng.random(n) < 0.2 + 0.1 * race / 2 + 0.02 * x
    rows = [
        (2000, ["White", "Black", "AIAN"][r], bool(b), float(k), 1, float(mean + v), "18-29")
        for r, b, k, v in zip(race, y, w, x, strict=True)
    ]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("again", 3 * F.col("x"))
    got = results(lpm.run_lpm_by_year(frame, ["x", "again"]))
    shifted = np.array([row[5] for row in rows]) - mean
    design = np.column_stack([race == 2, race == 1, race == 0, shifted]).astype(float) * np.sqrt(w)[:, None]
    beta = np.linalg.lstsq(design, y * np.sqrt(w), rcond=None)[0]
    assert got[2000, "x"].estimate == pytest.approx(beta[3], rel=1e-6)
    for name, value in zip(("AIAN", "Black", "White"), beta, strict=False):
        assert got[2000, f"race_eth{name}"].estimate == pytest.approx(value - mean * beta[3], rel=1e-6)
    assert got[2000, "again"].estimate is None
    constant = frame.withColumn("x", F.lit(mean / 3))
    assert results(lpm.run_lpm_by_year(constant, ["x"]))[2000, "x"].estimate is None


def test_boolean_controls_are_categories(frame):
    flagged = frame.withColumn("flag", F.col("n_child") > 2)
    number = frame.withColumn("flag", (F.col("n_child") > 2).cast("int"))
    got = results(lpm.run_lpm_by_year(flagged, ["flag"]))
    same = results(lpm.run_lpm_by_year(number, ["flag"]))
    assert got[2000, "flagTRUE"].estimate == pytest.approx(same[2000, "flag"].estimate)


def test_no_degrees_of_freedom(spark):
    rows = [(2000, "White", True, 2.0, 1, 1.0, "18-29")]
    row = lpm.run_lpm_by_year(spark.createDataFrame(rows, SCHEMA)).first()
    assert row.estimate == 1.0 and row.std_error is None and row.p_value is None


def test_perfect_fit_has_no_statistic(spark):
    rows = [(2000, race, True, 2.0, k, 0.1 * k, "18-29") for race in ("White", "Black") for k in range(9)]
    got = results(lpm.run_lpm_by_year(spark.createDataFrame(rows, SCHEMA), ["x"]))
    assert got[2000, "race_ethWhite"].estimate == pytest.approx(1.0)
    assert got[2000, "race_ethWhite"].std_error == 0.0
    assert got[2000, "race_ethWhite"].statistic is None


def test_other_outcomes(frame):
    got = results(lpm.run_lpm_by_year(frame, outcome="n_child"))
    means = crosstab_mean(frame, "n_child", "PERWT", ["YEAR", "race_eth"])
    for row in means.collect():
        assert got[row.YEAR, f"race_eth{row.race_eth}"].estimate == pytest.approx(row.weighted_mean)


def test_shown_races(frame):
    shown = lpm.filter_by_race(lpm.run_lpm_by_year(frame, ["n_child"]))
    assert {(row.term, row.term_rank) for row in shown.collect()} == {
        ("Hispanic", 1), ("AIAN", 2), ("Black", 4), ("White", 5),
    }


@pytest.mark.parametrize(
    ("statistic", "freedom", "expected"),
    [
        # Quantiles of Student's t.
        (12.706204736, 1, 0.05),
        (2.228138852, 10, 0.05),
        (3.169272673, 10, 0.01),
        (1.983971519, 100, 0.05),
        (0.0, 5, 1.0),
    ],
)
def test_p_values(statistic, freedom, expected):
    assert lpm.two_sided_p(statistic, freedom) == pytest.approx(expected, rel=1e-5)


def test_p_value_of_many_rows_is_normal():
    assert lpm.two_sided_p(1.959963985, 5e7) == pytest.approx(0.05, rel=1e-6)
    for freedom in (1e10, 1e12):
        for t in (0.5, 1.959963985, 4.0):
            normal = math.erfc(t / math.sqrt(2))
            assert lpm.two_sided_p(t, freedom) == pytest.approx(normal, rel=1e-9)
    assert lpm.two_sided_p(40.0, 5e7) == pytest.approx(0.0, abs=1e-300)


def test_only_sums_reach_python(spark, small):
    """Rows are reduced before the grouped solve: its input is a final aggregate."""
    model = lpm.run_lpm_by_year(queries.model_frame(spark, small), lpm.MODEL_CONTROLS["ses"])
    plan = model._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("FlatMapGroupsInPandas", 1)[1]
    assert below.strip().splitlines()[1].strip().lstrip("+- ").startswith(("Aggregate", "Project"))
    assert plan.count("PythonUDF") + plan.count("FlatMapGroupsInPandas") <= 2
