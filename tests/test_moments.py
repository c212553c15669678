"""Moments that merge, against moments of all rows at once."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthtab.operators import lpm, moments
from hearthtab.plans import queries
from tests.compare import spark_rows

KEYS, VALUES = ["YEAR", "race"], ["x", "y"]


def _rows(n, mean=0.0, seed=1):
    rng = np.random.default_rng(seed)
    return [
        (2000 + int(rng.integers(2)), [None, "a", "b"][rng.integers(3)], None if rng.random() < 0.1 else float(rng.integers(1, 9)),
         float(mean + rng.normal()), float(rng.normal()))
        for _ in range(n)
    ]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "YEAR int, race string, w double, x double, y double")


def _expected(rows, mean=0.0):
    cells = {}
    for year, race, w, x, y in rows:
        cells.setdefault((year, race), []).append((w, x - mean, y))
    out = {}
    for cell, held in cells.items():
        held = np.array([h for h in held if h[0] is not None]).reshape(-1, 3)
        w, z = held[:, 0], held[:, 1:]
        if not len(w):
            out[cell] = (0, 0.0, None, None)
            continue
        centre = (w[:, None] * z).sum(axis=0) / w.sum()
        off = z - centre
        out[cell] = (len(w), w.sum(), centre, (w[:, None, None] * off[:, :, None] * off[:, None, :]).sum(axis=0))
    return out


@pytest.mark.parametrize("mean", [0.0, 1e6, 1e9])
@pytest.mark.parametrize("parts", [1, 7])
def test_gathered_and_merged(spark, mean, parts):
    rows = _rows(500, mean)
    df = _frame(spark, rows).repartition(parts)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = moments.merge(moments.gather(df, KEYS, VALUES, "w"), KEYS, 2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = _expected(rows, mean)
    assert {(r.YEAR, r.race) for r in found} == set(want)
    for r in found:
        n, weight, centre, products = want[r.YEAR, r.race]
        assert (r.rows, r.weight) == (n, pytest.approx(weight))
        if n:
            assert np.array(r.means) - [mean, 0] == pytest.approx(centre, abs=1e-9 + 4e-16 * mean)
            upper = [products[0, 0], products[0, 1], products[1, 1]]
            assert r.products == pytest.approx(upper, rel=1e-6, abs=1e-6)


def test_cells_without_weight_and_empty_tables(spark):
    df = _frame(spark, [(2000, "a", None, 1.0, 1.0), (2000, "b", 2.0, 3.0, 4.0)])
    found = {r.race: r for r in moments.merge(moments.gather(df, KEYS, VALUES, "w"), KEYS, 2).collect()}
    assert found["a"].rows == 0 and found["a"].weight == 0.0
    assert found["b"].means == [3.0, 4.0] and found["b"].products == [0.0, 0.0, 0.0]
    assert moments.gather(df.where("false"), KEYS, VALUES, "w").collect() == []


def test_merging_in_any_order(spark):
    rows = _rows(300, 1e5)
    parts = [moments.merge(moments.gather(_frame(spark, rows[k::3]), KEYS, VALUES, "w"), KEYS, 2) for k in range(3)]
    left = moments.merge(moments.merge(parts[0].union(parts[1]), KEYS, 2).union(parts[2]), KEYS, 2)
    right = moments.merge(parts[2].union(moments.merge(parts[1].union(parts[0]), KEYS, 2)), KEYS, 2)
    both = {(r.YEAR, r.race): r for r in right.collect()}
    for r in left.collect():
        other = both[r.YEAR, r.race]
        assert r.rows == other.rows and r.products == pytest.approx(other.products, rel=1e-9, abs=1e-9)


def test_stored_moments_take_in_a_year(spark, small):
    frame, controls = queries.model_frame(spark, small), lpm.MODEL_CONTROLS["ses"]
    stored = lpm.model_moments(frame.where("YEAR <> 2010"), controls)
    year = lpm.model_moments(frame.where("YEAR = 2010"), controls)
    added = lpm.fit_moments(lpm.merge_model_moments(stored, year), controls)
    whole = lpm.run_lpm_by_year(frame, controls)
    digits = lambda df: spark_rows(df.select("YEAR", "term", "baseline", *[F.round(c, 6).alias(c) for c in ("estimate", "std_error")]))
    assert digits(added) == digits(whole)


def test_the_model_reads_its_rows_once(spark, small):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    frame = queries.model_frame(spark, small)
    rows = frame.count()
    counted = frame.mapInArrow(count, frame.schema)
    lpm.run_lpm_by_year(counted, lpm.MODEL_CONTROLS["ses"]).collect()
    assert seen.value == rows
