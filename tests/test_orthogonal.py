"""Triangular blocks against least squares over all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthtab.operators import lpm, orthogonal
from hearthtab.plans import queries
from tests.test_lpm import SCHEMA, frame, results  # noqa: F401


@pytest.mark.parametrize("controls", [(), ("n_child",), ("age_bucket",), ("age_bucket", "n_child", "x")])
def test_equals_the_solution_from_moments(frame, controls):  # noqa: F811
    want = results(lpm.run_lpm_by_year(frame, controls))
    got = results(lpm.run_lpm_by_year(frame.repartition(5), controls, method="orthogonal"))
    assert got.keys() == want.keys()
    for key, row in want.items():
        for name in ("estimate", "std_error", "statistic"):
            assert got[key][name] == pytest.approx(row[name], rel=1e-7, abs=1e-10)
        assert got[key].p_value == pytest.approx(row.p_value, rel=1e-6, abs=1e-12)
        assert got[key].baseline == row.baseline


@pytest.mark.parametrize("relative", [1e-3, 1e-5, 1e-6, 1e-7])
def test_nearly_collinear_controls(spark, relative):
    rng = np.random.default_rng(11)
    n = 3000
    race, x, other, w = rng.integers(0, 3, n), rng.normal(0, 1, n), rng.normal(0, 1, n), rng.integers(1, 9, n)
    near = x + relative * other
    y = rng.random(n) < 0.2 + 0.1 * race / 2 + 0.02 * x
    rows = [
        (2000, ["White", "Black", "AIAN"][r], bool(b), float(k), 1, float(v), "18-29") for r, b, k, v in zip(race, y, w, x)
    ]
    numbered = [(*row, float(v)) for row, v in zip(rows, near)]
    df = spark.createDataFrame(numbered, SCHEMA + ", near double").repartition(4)
    got = results(lpm.run_lpm_by_year(df, ["x", "near"], method="orthogonal"))
    root = np.sqrt(w)[:, None]
    # The same model in columns that are not collinear: near = x + (near - x).
    design = np.column_stack([race == 2, race == 1, race == 0, x, (near - x) / relative]).astype(float) * root
    beta = np.linalg.lstsq(design, y * root[:, 0], rcond=None)[0]
    want = [*beta[:3], beta[3] - beta[4] / relative, beta[4] / relative]
    # Rounding of the data themselves: near - x has digits down to 1e-16 / relative only.
    digits = 1e-8 + 4e-16 / relative
    for term, value in zip(["race_ethAIAN", "race_ethBlack", "race_ethWhite", "x", "near"], want):
        assert got[2000, term].estimate == pytest.approx(value, rel=digits)


def test_collinear_controls_are_null(frame):  # noqa: F811
    doubled = frame.withColumn("twice", 2 * F.col("n_child")).withColumn("fixed", F.lit(3.0))
    got = results(lpm.run_lpm_by_year(doubled, ["n_child", "twice", "fixed"], method="orthogonal"))
    alone = results(lpm.run_lpm_by_year(frame, ["n_child"]))
    assert got[2000, "twice"].estimate is None and got[2000, "fixed"].estimate is None
    assert got[2000, "n_child"].estimate == pytest.approx(alone[2000, "n_child"].estimate)
    assert got[2000, "n_child"].std_error == pytest.approx(alone[2000, "n_child"].std_error)


def test_rows_without_control_years_without_rows_and_perfect_fits(spark):
    rows = [
        (2000, "White", True, 2.0, k, 0.1 * k, "18-29") for k in range(6)
    ] + [(2000, "AAPI", True, 2.0, None, 1.0, "18-29"), (2010, "White", True, 2.0, None, 1.0, "18-29")]
    got = results(lpm.run_lpm_by_year(spark.createDataFrame(rows, SCHEMA), ["n_child"], method="orthogonal"))
    assert {year for year, _ in got} == {2000}
    row = got[2000, "race_ethWhite"]
    assert row.estimate == pytest.approx(1.0) and row.std_error == 0.0 and row.statistic is None
    assert row.baseline == "AAPI"
    with pytest.raises(ValueError):
        lpm.run_lpm_by_year(spark.createDataFrame(rows, SCHEMA), method="other")


def test_blocks_do_not_grow_with_rows(spark, small):
    frame = queries.model_frame(spark, small)
    categories, numbers = lpm._split_controls(frame, lpm.MODEL_CONTROLS["ses"])
    prepared = lpm._prepared(frame, categories, numbers, "is_multifam")
    found = orthogonal.blocks(prepared, lpm.RACE, categories, numbers, "is_multifam", lpm.MODEL_CONTROLS["ses"])
    assert all(len(r.block) <= len(r.terms) ** 2 <= 16**2 for r in found.collect())


def test_merging_in_any_order():
    rng = np.random.default_rng(2)
    terms = [(0, "a"), (0, "b"), (1, "x"), (2, "y")]
    parts = [(terms[k % 2 :], rng.normal(size=(9, 4 - k % 2))) for k in range(5)]
    one = orthogonal.merge(parts)
    two = orthogonal.merge([orthogonal.merge(parts[3:]), orthogonal.merge([parts[1], parts[0]]), parts[2]])
    assert one[0] == two[0] == terms
    assert one[1].T @ one[1] == pytest.approx(two[1].T @ two[1])
