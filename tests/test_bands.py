from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from hearthtab.functions import bands
from hearthtab.operators import rent


def ranks(spark, values, **options):
    rows = [(k, value) for k, value in enumerate(values)]
    df = spark.createDataFrame(rows, "k int, x double")
    ranked = df.withColumn("r", bands.band_rank("x", **options))
    return [row.r for row in ranked.orderBy("k").collect()]


def test_burden_bands_are_closed_on_the_left(spark):
    values = [0.0, 0.05, 0.1499999, 0.15, 1.95, 1.9999, 2.0, 2.5, -0.1, None]
    # 0.15 and 1.95 are below the doubles 3 * 0.05 and 39 * 0.05: the band before.
    expected = [1, 2, 3, 3, 39, 40, 40, None, None, None]
    assert ranks(spark, values, breaks=bands.BURDEN_BREAKS) == expected


def test_right_closed_bins_with_tolerance(spark):
    values = [0.0, 0.05, 0.050000004, 0.051, 2.0, 2.1, -0.1]
    got = ranks(
        spark, values, breaks=bands.BURDEN_BREAKS, right=True, tolerance=rent.HISTOGRAM_TOLERANCE
    )
    assert got == [1, 1, 1, 2, 40, None, None]


def test_labels():
    assert bands.BURDEN_LABELS[:3] == ["0–4.9", "5–9.9", "10–14.9"]
    assert bands.BURDEN_LABELS[-1] == "195–199.9"
    assert bands.RENT_LABELS[0] == "$0–$200"
    assert bands.RENT_LABELS[-1] == "$3800–$4000"
    assert len(bands.BURDEN_LABELS) == 40 and len(bands.RENT_LABELS) == 20


def test_rent_bands(spark):
    rows = [(0,), (199,), (200,), (3999,), (4000,), (4001,), (None,)]
    df = rent.with_rent_band(spark.createDataFrame(rows, "RENT int"))
    assert [row.band for row in df.collect()] == [
        "$0–$200", "$0–$200", "$200–$400", "$3800–$4000", "$3800–$4000", None, None,
    ]


def test_divisions_by_zero_are_null(spark):
    df = spark.createDataFrame([(600, 0, 0.0), (600, 2, 14400.0)], "RENT int, NFAMS int, inc double")
    got = df.select(
        bands.rent_per_family(F.col("RENT"), F.col("NFAMS")).alias("per_family"),
        bands.rent_burden(F.col("RENT"), F.col("inc")).alias("burden"),
        bands.rent_burden(F.col("RENT"), F.col("inc"), months=13).alias("burden_13"),
    ).collect()
    assert tuple(got[0]) == (None, None, None)
    assert tuple(got[1]) == (300.0, 0.5, 7800 / 14400)


def test_histogram_keeps_empty_bins(spark):
    frame = spark.createDataFrame(
        [(2, 1000, 60_000.0), (2, 1000, 61_000.0)], "OWNERSHP int, RENT int, hhinc_harmonized double"
    )
    rows = rent.rent_burden_histogram(frame).orderBy("band_rank").collect()
    assert len(rows) == 40 and sum(r.n for r in rows) == 2
    assert [r.band for r in rows if r.n] == ["0.20–0.25"]
    assert {r.n for r in rows if r.band != "0.20–0.25"} == {0}


@pytest.mark.parametrize(
    ("low", "high", "bins", "unit", "count"),
    [
        # Worked out by hand.
        (0, 1, 5, 0.2, 5),
        (0, 100, 50, 2, 50),
        (0.013, 1.97, 50, 0.05, 40),
        (1, 10, 5, 2, 5),
        (0.1, 0.73, 50, 0.01, 63),
        (-3, 3, 6, 1, 6),
        (0, 37, 10, 5, 8),
    ],
)
def test_pretty_breaks(low, high, bins, unit, count):
    breaks = bands.pretty_breaks(low, high, bins)
    assert len(breaks) == count + 1
    assert breaks[1] - breaks[0] == pytest.approx(unit)
    assert breaks[0] <= low < breaks[1] and breaks[-2] < high <= breaks[-1]


def test_pretty_breaks_of_one_value():
    for value in (0.0, 5.0, -1e-9, 123456.0):
        breaks = bands.pretty_breaks(value, value)
        assert len(breaks) >= 2 and breaks[0] <= value <= breaks[-1]
    with pytest.raises(ValueError):
        bands.pretty_breaks(2, 1)
    with pytest.raises(ValueError):
        bands.pretty_breaks(0, math.inf)


def test_histogram_over_its_own_range(spark):
    values = [0.1, 0.105, 0.11, 0.11, 0.1100000000001, 0.25, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = {round(r.high, 9): r.n for r in rent.histogram(df, "v").collect()}
    step = round(min(found) - 0.1, 9)
    assert sum(found.values()) == 6 and step == 0.002 or step == 0.005
    for high, n in found.items():
        inside = [v for v in values if v is not None and (high - step + 1e-9 < v <= high + 1e-9 or (high == min(found) and v == 0.1))]
        assert n == len(inside)
    assert rent.histogram(df.where("v is null"), "v").collect() == []
    assert [r.n for r in rent.histogram(df.where("v = 0.25"), "v").collect() if r.n] == [1]
