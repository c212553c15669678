"""Every query by name: ``(spark, folder of the test tables) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthtab.functions.income import add_harmonized_income
from hearthtab.functions.recode import capped, recode_person
from hearthtab.operators import components, lpm, rent
from hearthtab.operators.crosstab import crosstab_count, crosstab_mean, crosstab_percent
from hearthtab.operators.household import (
    HOUSEHOLD_COLUMNS,
    HOUSEHOLD_CONSTANTS,
    PERSON_KEY,
    household_rollup,
    join_household,
    reference_persons,
)
from hearthtab.operators.skew import HeavyKeys
from hearthtab.plans import build, colocated, fixture, published
from hearthtab.sources import fixed_width, tables, versions
from hearthtab.sources.workspace import new_location

Query = Callable[[SparkSession, str], DataFrame]

# Person columns that do not depend on the rest of the household.
FLAT_COLUMNS = tuple(
    name for name in fixture.PERSON_COLUMNS if name not in ("PERNUM", "RELATE", "NUMPREC")
)
# Smallest cell of the crowding table; the test tables' cells are far below 100.
TEST_MIN_COUNT = 5
CITY_SHOWN = 5350
# Households whose burdens cover only a part of the fixed histogram's range.
HISTOGRAM_INCOME = 60_000


def flat_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recoded persons for tables by year, race, age and family count."""
    return recode_person(fixture.person(spark, sf_dir, FLAT_COLUMNS), allow_missing=True)


def numbered_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recoded persons with their place in the household and harmonized income."""
    return add_harmonized_income(recode_person(fixture.person(spark, sf_dir)))


def recoded_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recoded persons with their place in the household, without income."""
    return recode_person(fixture.person(spark, sf_dir))


def household(spark: SparkSession, sf_dir: str) -> DataFrame:
    return household_rollup(numbered_person(spark, sf_dir))


def household_without_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    return household_rollup(recoded_person(spark, sf_dir))


def first_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working-age reference persons with their own columns only: no rollup is needed."""
    return recode_person(rent.model_population(fixture.person(spark, sf_dir)))


def model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working-age reference persons with household columns."""
    first = reference_persons(numbered_person(spark, sf_dir))
    return recode_person(rent.model_population(first))


def with_household(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All persons with their household's columns."""
    heavy = fixture.heavy_households(spark, sf_dir)
    person = add_harmonized_income(recode_person(fixture.person(spark, sf_dir, heavy=heavy)))
    return join_household(person, household_rollup(person), heavy)


def _hot_person(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, HeavyKeys]:
    """Persons of the view with one household of a third of all orders, and its heavy keys."""
    heavy = fixture.heavy_households(spark, sf_dir, fixture.HOT_LIMITS, hot=True)
    person = fixture.person(spark, sf_dir, heavy=heavy, hot=True)
    return add_harmonized_income(recode_person(person)), heavy


def household_rollup_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return household_rollup(_hot_person(spark, sf_dir)[0])


def person_with_household_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    person, heavy = _hot_person(spark, sf_dir)
    return _merged_columns(join_household(person, household_rollup(person), heavy))


def _recoded(*columns: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return recoded_person(spark, sf_dir).select(*PERSON_KEY, *columns)

    return query


def _of(source: Query, table: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(source(spark, sf_dir))

    return query


def _rounded(table: DataFrame, digits: int, *columns: str) -> DataFrame:
    return table.withColumns({name: F.round(name, digits) for name in columns})


def _household_size_counts(person: DataFrame) -> DataFrame:
    sized = person.withColumn("size_group", capped(F.col("NUMPREC"), 6))
    return crosstab_count(sized, "PERWT", ["size_group", "race_eth"])


def _lpm(variant: str, all_terms: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        controls = lpm.MODEL_CONTROLS[variant]
        # Only some controls are columns of the household.
        frame = model_frame if set(controls) & set(HOUSEHOLD_COLUMNS) else first_persons
        results = lpm.run_lpm_by_year(frame(spark, sf_dir), controls)
        shown = results if all_terms else lpm.filter_by_race(results)
        return _rounded(shown, 6, "estimate", "std_error", "statistic", "p_value")

    return query


def lpm_shifted_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model whose control has a mean far above its spread."""
    frame = model_frame(spark, sf_dir).withColumn("shifted_rent", F.col("RENT") + 1_000_000)
    results = lpm.run_lpm_by_year(frame, ["shifted_rent"])
    return _rounded(results, 6, "estimate", "std_error", "statistic", "p_value")


def lpm_sufficient_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross products of the SES model, income in whole hundreds to keep the sums exact."""
    hundreds = model_frame(spark, sf_dir).withColumn(
        "hhinc_harmonized", F.floor(F.col("hhinc_harmonized") / 100)
    )
    return lpm.lpm_sufficient_stats(hundreds, lpm.MODEL_CONTROLS["ses"]).select("YEAR", "i", "j", "value")


def _build(spark: SparkSession, sf_dir: str) -> build.StageTables:
    return build.build_tables(fixture.person(spark, sf_dir), new_location(spark, "stages"))


def row_count_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows expected and found in each stage table, as counted while the tables were built."""
    order = ("person recode", "unique person key", "household rollup", "person with household")
    rows = [(order.index(step) + 1, step, expected, actual)
            for step, expected, actual in _build(spark, sf_dir).checks]
    return spark.createDataFrame(rows, "step_number int, step string, expected long, actual long")


def build_stage_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged stage table of a whole build."""
    return _merged_columns(_build(spark, sf_dir).person_with_household)


def person_with_household(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged_columns(with_household(spark, sf_dir))


def _merged_columns(merged: DataFrame) -> DataFrame:
    both = [c for name in HOUSEHOLD_CONSTANTS for c in (name, f"{name}_hh")]
    both += ["n_multifam", "n_multifam_hh", "is_multifam", "is_multifam_hh"]
    added = ["hh_size", "hhinc_harmonized", "n_adults", "n_children", *components.COMPONENTS]
    return merged.select(*PERSON_KEY, *both, *added)


def colocated_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged table from stage tables that lie by household."""
    person = add_harmonized_income(recode_person(fixture.person(spark, sf_dir)))
    stored = colocated.store_households(person, new_location(spark, "colocated"))
    return _merged_columns(stored.person_with_household)


def lpm_ses_orthogonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SES model by triangular blocks."""
    results = lpm.run_lpm_by_year(model_frame(spark, sf_dir), lpm.MODEL_CONTROLS["ses"], method="orthogonal")
    return _rounded(lpm.filter_by_race(results), 6, "estimate", "std_error", "statistic", "p_value")


def lpm_ses_added_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SES model from stored moments of the years before 2000 to which the later ones are added."""
    frame, controls = model_frame(spark, sf_dir), lpm.MODEL_CONTROLS["ses"]
    path = new_location(spark, "moments")
    for years in ("YEAR < 2000", "YEAR >= 2000"):
        lpm.model_moments(frame.where(years), controls).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    results = lpm.fit_moments(lpm.merge_model_moments(stored, stored.limit(0)), controls)
    return _rounded(lpm.filter_by_race(results), 6, "estimate", "std_error", "statistic", "p_value")


def append_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged stage table of a build of all years but the latest two, to which these are added in two
    steps, one of them twice.
    """
    person, folder = fixture.person(spark, sf_dir), new_location(spark, "stages")
    last = rent.LATEST_YEAR
    build.build_tables(person.where(F.col("YEAR") < last - 1), folder)
    for year in (last, last - 1, last):
        build.replace_years(person, folder, [year])
    return _merged_columns(build.read_tables(spark, folder).person_with_household)


def write_read_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons written over a first version that has only some of them."""
    person, folder = fixture.person(spark, sf_dir), new_location(spark, "person")
    for rows in (person.where("YEAR < 2000"), person):
        with versions.Change(spark, folder) as change:
            change.write("person", rows)
    return versions.read_version(spark, folder, "person")


def _csv_roundtrip(source: Query, order_by: tuple[str, ...], measure: str, quote: bool) -> Query:
    """The lines of a result file, header included, after writing it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = new_location(spark, "result")
        # To six digits, as sums of floating point numbers depend on their order.
        tables.write_result_csv(_rounded(source(spark, sf_dir), 6, measure), path, order_by, quote)
        return spark.read.text(path).withColumnRenamed("value", "line")

    return query


def ingest_fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the persons as a gzip extract and read them back by its codebook."""
    path = new_location(spark, "extract")
    book = new_location(spark, "codebook")
    fixed_width.write_fixed_width(fixture.person(spark, sf_dir), path, fixture.RECORD_LAYOUT)
    fixed_width.write_codebook(spark, book, fixture.RECORD_LAYOUT)
    read = fixed_width.read_fixed_width(spark, path, fixed_width.read_codebook(spark, book))
    return read.withColumns({name: F.col(name).cast("double") for name in ("PERWT", "HHWT")})


def rent_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = rent.with_rent_burden(rent.renters(model_frame(spark, sf_dir)))
    return frame.select(*PERSON_KEY, "rent_burden")


QUERIES: dict[str, Query] = {
    "select_samples": _of(
        fixture.person, lambda person: tables.select_samples(person, allow_missing=True)
    ),
    "write_read_roundtrip": write_read_roundtrip,
    "published_csv_roundtrip": _csv_roundtrip(
        _of(recoded_person, published.hhsize_by_year), ("YEAR",), "weighted_mean", quote=False
    ),
    "published_csv_quoted_roundtrip": _csv_roundtrip(
        _of(flat_person, published.multifam_share_by_race), ("YEAR", "race_eth"), "percent", quote=True
    ),
    "ingest_fixed_width": ingest_fixed_width,
    "recode_family_count": _recoded("n_multifam"),
    "recode_is_multifam": _recoded("is_multifam"),
    "recode_rooms": _recoded("room"),
    "recode_bedrooms": _recoded("bedroom"),
    "persons_per_bedroom": _recoded("ppbr"),
    "recode_age_bucket": _recoded("age_bucket"),
    "recode_race_eth": _recoded("is_hispan", "race_bucket", "race_eth"),
    "income_harmonized": _of(
        numbered_person,
        lambda person: person.select(
            *PERSON_KEY, F.col("inctot_harmonized").cast("double").alias("inctot_harmonized")
        ),
    ),
    "household_rollup": household,
    "person_with_household": person_with_household,
    "household_rollup_hot": household_rollup_hot,
    "person_with_household_hot": person_with_household_hot,
    "row_count_checks": row_count_checks,
    "build_stage_tables": build_stage_tables,
    "append_year": append_year,
    "colocated_merge": colocated_merge,
    "crosstab_count": _of(recoded_person, _household_size_counts),
    "crosstab_mean": _of(
        flat_person, lambda person: crosstab_mean(person, "AGE", "PERWT", ["YEAR", "race_eth"])
    ),
    "crosstab_percent": _of(
        flat_person,
        lambda person: crosstab_percent(
            person, "PERWT", ["n_multifam", "race_eth", "age_bucket"], ["race_eth", "age_bucket"]
        ),
    ),
    "hhsize_by_year": _of(recoded_person, published.hhsize_by_year),
    "multifam_share_by_year": _of(flat_person, published.multifam_share_by_year),
    "multifam_share_by_race": _of(flat_person, published.multifam_share_by_race),
    "multifam_share_by_age": _of(flat_person, published.multifam_share_by_age),
    "multifam_share_tables": _of(flat_person, published.multifam_share_tables),
    "gq_share_by_race": _of(flat_person, published.gq_share_by_race),
    "multifam_hh_count": _of(household_without_income, published.multifam_hh_count),
    "multifam_hh_percent": _of(household_without_income, published.multifam_hh_percent),
    "hh_component_mean": _of(
        household_without_income, lambda table: components.get_component_mean(table, "n_child")
    ),
    "hh_components": _of(household_without_income, components.hh_components),
    "hh_components_long": _of(
        household_without_income, lambda table: components.hh_components_long(components.hh_components(table))
    ),
    "hh_components_normalized": _of(
        household_without_income,
        lambda table: _rounded(
            components.normalize_to_year(components.hh_components(table)),
            9,
            *components.COMPONENTS,
        ),
    ),
    "hh_components_normalized_long": _of(
        household_without_income,
        lambda table: _rounded(
            components.hh_components_normalized_long(
                components.normalize_to_year(components.hh_components(table))
            ),
            9,
            "relative_value",
        ),
    ),
    "multifam_by_children": _of(model_frame, rent.multifam_by_children),
    "multifam_by_children_cap2": _of(
        model_frame, lambda frame: rent.multifam_by_children(frame, cap=2)
    ),
    "rent_burden": rent_burden,
    "rent_burden_by_children": _of(
        model_frame,
        lambda frame: _rounded(rent.rent_burden_by_children(frame), 6, "mean_rent_burden"),
    ),
    "rent_burden_bands": _of(model_frame, rent.rent_burden_bands),
    "rent_bands": _of(model_frame, rent.rent_bands),
    "rent_burden_histogram": _of(model_frame, rent.rent_burden_histogram),
    "rent_burden_histogram_of_range": _of(
        model_frame,
        lambda frame: _rounded(
            rent.rent_burden_histogram_of_range(frame, HISTOGRAM_INCOME), 9, "low", "high"
        ),
    ),
    "rent_burden_by_city": _of(model_frame, rent.rent_burden_by_city),
    "rent_burden_by_city_all_years": _of(
        model_frame, lambda frame: rent.rent_burden_by_city(frame, years=None)
    ),
    "rent_burden_one_city": _of(
        model_frame,
        lambda frame: rent.split_by_city(rent.rent_burden_by_city(frame, None), CITY_SHOWN)[
            "one_city"
        ],
    ),
    "low_income_rent_burden": _of(model_frame, rent.low_income_rent_burden),
    "low_income_rent_burden_all_years": _of(
        model_frame, lambda frame: rent.low_income_rent_burden(frame, years=None)
    ),
    "rent_per_family_bands": _of(model_frame, rent.rent_per_family_bands),
    "rent_per_family_bands_all_years": _of(
        model_frame, lambda frame: rent.rent_per_family_bands(frame, years=None)
    ),
    "ppbr_by_rent_burden": _of(
        model_frame,
        lambda frame: _rounded(
            rent.ppbr_by_rent_burden(frame, min_count=TEST_MIN_COUNT), 6, "weighted_mean"
        ),
    ),
    "lpm_base": _lpm("base"),
    "lpm_child": _lpm("child"),
    "lpm_demo": _lpm("demo"),
    "lpm_ses": _lpm("ses"),
    "lpm_ses_terms": _lpm("ses", all_terms=True),
    "lpm_ses_added_years": lpm_ses_added_years,
    "lpm_ses_orthogonal": lpm_ses_orthogonal,
    "lpm_shifted_control": lpm_shifted_control,
    "lpm_sufficient_stats": lpm_sufficient_stats,
}
