"""Rent burden, rent bands and crowding of reference persons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthtab.functions import bands
from hearthtab.functions.recode import capped
from hearthtab.operators.crosstab import crosstab_mean, crosstab_percent

CHILD_CAP = 8
LATEST_YEAR = 2023
LOW_INCOME = 20000
RENT_LIMIT = 4000
RENTED = 2
# Years compared in the crowding table.
CROWDING_YEARS = (2000, 2010, 2020, 2023)
# Histogram bins are widened by this part of their width.
RELATIVE_TOLERANCE = 1e-7
HISTOGRAM_TOLERANCE = RELATIVE_TOLERANCE * 0.05


def model_population(person_with_household: DataFrame) -> DataFrame:
    """Reference persons of working age."""
    return person_with_household.where(F.col("AGE").between(18, 65) & (F.col("PERNUM") == 1))


def renters(data: DataFrame) -> DataFrame:
    """Renters with known rent and positive household income."""
    return data.where(
        (F.col("OWNERSHP") == RENTED)
        & F.col("RENT").isNotNull()
        & F.col("hhinc_harmonized").isNotNull()
        & (F.col("hhinc_harmonized") > 0)
    )


def with_rent_burden(data: DataFrame, months: int = 12) -> DataFrame:
    burden = bands.rent_burden(F.col("RENT"), F.col("hhinc_harmonized"), months)
    return data.withColumn("rent_burden", burden)


def burden_between(data: DataFrame, low: float, high: float) -> DataFrame:
    return data.where((F.col("rent_burden") > low) & (F.col("rent_burden") < high))


def _with_band(
    data: DataFrame, value: str, breaks: Sequence[float], labels: Sequence[str]
) -> DataFrame:
    ranked = data.withColumn("band_rank", bands.band_rank(value, breaks))
    return ranked.withColumn("band", bands.band_label("band_rank", labels))


def with_burden_band(data: DataFrame) -> DataFrame:
    return _with_band(data, "rent_burden", bands.BURDEN_BREAKS, bands.BURDEN_LABELS)


def with_rent_band(data: DataFrame, value: str = "RENT") -> DataFrame:
    return _with_band(data, value, bands.RENT_BREAKS, bands.RENT_LABELS)


def _in_years(data: DataFrame, years: Sequence[int] | None) -> DataFrame:
    return data if years is None else data.where(F.col("YEAR").isin(*years))


def multifam_by_children(data: DataFrame, cap: int = CHILD_CAP) -> DataFrame:
    """Unweighted share of multifamily households by number of children."""
    return (
        data.withColumn("n_child_group", capped(F.col("n_child"), cap))
        .groupBy("n_child_group")
        .agg(
            F.avg(F.col("is_multifam").cast("int")).alias("p_multifam"),
            F.count("*").alias("n"),
        )
    )


def rent_burden_by_children(data: DataFrame, cap: int = CHILD_CAP) -> DataFrame:
    """Unweighted mean rent burden of renters by number of children."""
    return (
        burden_between(with_rent_burden(renters(data)), 0, 2)
        .withColumn("n_child_group", capped(F.col("n_child"), cap))
        .groupBy("n_child_group")
        .agg(F.avg("rent_burden").alias("mean_rent_burden"), F.count("*").alias("n"))
    )


def rent_burden_bands(data: DataFrame) -> DataFrame:
    """Renters per rent-burden band."""
    banded = with_burden_band(burden_between(with_rent_burden(renters(data)), 0, 2))
    return banded.groupBy("band", "band_rank").agg(F.count("*").alias("n"))


def rent_bands(data: DataFrame) -> DataFrame:
    """Renters per rent band; rents outside the bands are a NULL band."""
    return with_rent_band(renters(data)).groupBy("band", "band_rank").agg(F.count("*").alias("n"))


def rent_burden_histogram(data: DataFrame, months: int = 13) -> DataFrame:
    """Counts of rent burden in right-closed bins of 0.05, empty bins included.

    The published histogram multiplies the monthly rent by 13.
    """
    burden = burden_between(with_rent_burden(renters(data), months), 0, 2)
    rank = bands.band_rank(
        "rent_burden", bands.BURDEN_BREAKS, right=True, tolerance=HISTOGRAM_TOLERANCE
    )
    found = burden.groupBy(rank.alias("band_rank")).agg(F.count("*").alias("n"))
    bins = data.sparkSession.range(1, len(bands.BURDEN_LABELS) + 1).select(
        F.col("id").cast("int").alias("band_rank")
    )
    return bins.join(found, "band_rank", "left").select(
        "band_rank",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.format_string("%.2f–%.2f", (F.col("band_rank") - 1) / 20, F.col("band_rank") / 20).alias(
            "band"
        ),
    )


def histogram(data: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts of a number in about ``bins`` right-closed bins between round breaks that fit its range.

    Columns: band_rank, low, high, n; empty bins included, rows without the value left out. The range is
    one row of two numbers, so a stored column is read twice and nothing else moves but counts.
    """
    known = data.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("value"))
    low, high = known.agg(F.min("value"), F.max("value")).first()
    schema = "band_rank int, low double, high double"
    if low is None:
        return data.sparkSession.createDataFrame([], f"{schema}, n bigint")
    breaks = bands.pretty_breaks(low, high, bins)
    tolerance = RELATIVE_TOLERANCE * (breaks[1] - breaks[0])
    rank = bands.band_rank("value", breaks, right=True, tolerance=tolerance)
    found = known.groupBy(rank.alias("band_rank")).agg(F.count("*").alias("n"))
    ends = [(k, a, b) for k, (a, b) in enumerate(zip(breaks, breaks[1:], strict=False), 1)]
    return (
        data.sparkSession.createDataFrame(ends, schema)
        .join(found, "band_rank", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    )


def rent_burden_histogram_of_range(data: DataFrame, least_income: int, months: int = 13) -> DataFrame:
    """The rent burden's histogram over its own range, of households from an income up."""
    well_off = renters(data).where(F.col("hhinc_harmonized") >= least_income)
    return histogram(burden_between(with_rent_burden(well_off, months), 0, 2), "rent_burden")


def rent_burden_by_city(
    data: DataFrame, years: Sequence[int] | None = (LATEST_YEAR,)
) -> DataFrame:
    """How multifamily renters with children spread over burden bands, by city."""
    families = renters(_in_years(data, years)).where(F.col("n_child") > 0)
    banded = with_burden_band(burden_between(with_rent_burden(families), 0, 2))
    table = crosstab_percent(
        banded, "PERWT", ["band", "band_rank", "is_multifam", "CITY"], ["is_multifam", "CITY"]
    )
    return table.where(F.col("is_multifam") & F.col("band").isNotNull())


def split_by_city(table: DataFrame, city: int) -> dict[str, DataFrame]:
    """The parts drawn separately: identified cities, no city, and one city."""
    return {
        "identified": table.where(F.col("CITY") != 0),
        "not_identified": table.where(F.col("CITY") == 0),
        "one_city": table.where(F.col("CITY") == city),
    }


def _low_income_renters(data: DataFrame, years: Sequence[int] | None) -> DataFrame:
    low = (F.col("hhinc_harmonized") >= 0) & (F.col("hhinc_harmonized") < LOW_INCOME)
    return with_rent_burden(renters(_in_years(data, years)).where(low))


def low_income_rent_burden(
    data: DataFrame, years: Sequence[int] | None = (LATEST_YEAR,)
) -> DataFrame:
    """How low-income multifamily renters spread over burden bands."""
    banded = with_burden_band(burden_between(_low_income_renters(data, years), 0, 2))
    table = crosstab_percent(
        banded, "HHWT_hh", ["band", "band_rank", "is_multifam"], ["is_multifam"]
    )
    return table.where(F.col("is_multifam") & F.col("band").isNotNull())


def rent_per_family_bands(
    data: DataFrame, years: Sequence[int] | None = (LATEST_YEAR,)
) -> DataFrame:
    """How low-income multifamily renters spread over bands of rent per family."""
    cheap = _low_income_renters(data, years).where(F.col("RENT") < RENT_LIMIT)
    per_family = cheap.withColumn(
        "rent_per_family", bands.rent_per_family(F.col("RENT"), F.col("NFAMS"))
    )
    table = crosstab_percent(
        with_rent_band(per_family, "rent_per_family"),
        "HHWT_hh",
        ["band", "band_rank", "is_multifam"],
        ["is_multifam"],
    )
    return table.where(F.col("is_multifam"))


def ppbr_by_rent_burden(
    data: DataFrame, years: Sequence[int] = CROWDING_YEARS, min_count: int = 100
) -> DataFrame:
    """Mean persons per bedroom by burden band and year, cells of ``min_count`` rows up."""
    crowded = renters(data).where(F.col("ppbr").isNotNull() & (F.col("ppbr") > 0))
    banded = with_burden_band(burden_between(with_rent_burden(crowded), 0, 1))
    table = crosstab_mean(banded, "ppbr", "HHWT_hh", ["band", "band_rank", "YEAR"])
    return table.where(F.col("YEAR").isin(*years) & (F.col("count") >= min_count))
