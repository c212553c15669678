"""From an extract to stage tables, published tables and models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hearthtab.functions.income import add_harmonized_income
from hearthtab.functions.recode import recode_person
from hearthtab.operators import components, lpm, rent
from hearthtab.operators.household import (
    HOUSEHOLD_KEY,
    PERSON_KEY,
    household_rollup,
    join_household,
    laid_order,
)
from hearthtab.operators.skew import DEFAULT_LIMITS, SkewLimits, find_heavy
from hearthtab.operators.validate import (
    ValidationError,
    validate_row_counts,
    validate_unique_key,
)
from hearthtab.plans import published
from hearthtab.plans.colocated import MOST_BUCKETS
from hearthtab.sources import versions
from hearthtab.sources.tables import write_result_csv
from hearthtab.sources.workspace import new_location

# Published tables whose CSV has a quoted header.
QUOTED_HEADERS = ("multifam_hh_count", "multifam_hh_percent")


@dataclass(frozen=True)
class StageTables:
    """The stage tables, and what was checked: step, expected and actual rows."""

    person: DataFrame
    household: DataFrame
    person_with_household: DataFrame
    checks: list[tuple[str, int, int]]


# Part of a year's households; in the files of the stages, not in the tables.
SLICE = "household_slice"
# Slices are made so that this many years have one per bucket: two per bucket in an extract of 28 years.
YEARS_OF_SLICES = 14
STAGE_NAMES = ("person", "household", "person_with_household")


def build_tables(
    extract: DataFrame, folder: str, limits: SkewLimits = DEFAULT_LIMITS, digests: bool = False
) -> StageTables:
    """Write the three stage tables, checking row counts and keys of what was written.

    The extract is parsed once: its rows are counted while they are written, and they are shuffled once, before
    they are recoded. Each year's households are dealt over slices, and all tables lie in buckets of these, so
    rollup and merge move nothing; if there are heavy households, they shuffle. All three tables become visible in one
    step, after the last check; until then readers see the earlier build. With ``digests`` each
    survey year's content is noted, for ``versions.changed_partitions``.
    """
    with versions.Change(extract.sparkSession, folder) as change:
        checks = _stage(extract, change, None, limits, digests)
    return _stage_tables(extract.sparkSession, folder, checks)


def replace_years(
    extract: DataFrame,
    folder: str,
    years: Sequence[int],
    limits: SkewLimits = DEFAULT_LIMITS,
    digests: bool = False,
) -> StageTables:
    """Add or replace survey years in all three stage tables, in one step.

    Only rows of ``years`` are taken from the extract, and only they are recoded, rolled up, merged and
    checked: a household lies in one year. Files of other years are neither read nor written. A year
    without rows in the extract is removed.
    """
    wanted = extract.where(F.col("YEAR").isin(*years))
    with versions.Change(extract.sparkSession, folder) as change:
        checks = _stage(wanted, change, list(years), limits, digests)
    return _stage_tables(extract.sparkSession, folder, checks)


def read_tables(spark: SparkSession, folder: str) -> StageTables:
    """The stage tables as they are now, all of one build."""
    return _stage_tables(spark, folder, [])


def _stage_tables(
    spark: SparkSession, folder: str, checks: list[tuple[str, int, int]]
) -> StageTables:
    manifest = versions.current_manifest(spark, folder)
    stages = [versions.read_version(spark, folder, name, manifest) for name in STAGE_NAMES]
    return StageTables(*stages, checks)


def _buckets(spark: SparkSession) -> versions.Buckets:
    return versions.Buckets(SLICE, min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS))


@contextmanager
def _joins_by_bucket(spark: SparkSession) -> Iterator[None]:
    """Joins planned in here take tables as they lie, also by a part of the join's keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _by_slice(extract: DataFrame, buckets: versions.Buckets) -> DataFrame:
    """The extract's rows gathered by slice: a part of one year's households.

    A slice lies in one bucket and a year in few slices, so a year has few files. Adaptive execution splits
    large slices while they are written.
    """
    per_year = -(-buckets.number // YEARS_OF_SLICES)
    place = F.pmod(F.xxhash64("SERIAL"), F.lit(per_year))
    sliced = extract.withColumn(SLICE, F.col("YEAR").cast("bigint") * per_year + place)
    return sliced.hint("rebalance", SLICE)


def _stage(
    extract: DataFrame,
    change: versions.Change,
    years: list[int] | None,
    limits: SkewLimits,
    digests: bool,
) -> list[tuple[str, int, int]]:
    """Write the stages of the extract's rows into the change; what was checked."""
    checks: list[tuple[str, int, int]] = []
    digest = versions.partition_digests() if digests else None

    def expect(step: str, expected: Callable[[], int]) -> Callable[[DataFrame], None]:
        def check(written: DataFrame) -> None:
            # Counted from the files' footers.
            actual = validate_row_counts(written, expected(), step)
            checks.append((step, expected(), actual))

        return check

    read = Observation()
    observed = extract.observe(read, F.count(F.lit(1)).alias("rows"))

    buckets = _buckets(extract.sparkSession)
    person = change.write(
        "person",
        add_harmonized_income(recode_person(_by_slice(observed, buckets))),
        cluster_by=("SERIAL", "PERNUM"),
        check=expect("person recode", lambda: read.get["rows"]),
        replace=years,
        digest=digest,
        buckets=buckets,
    )
    persons = person.count()

    # A bucket is read by one task, so heavy households are read from the files as they come.
    heavy = find_heavy(person.select(*HOUSEHOLD_KEY), HOUSEHOLD_KEY, limits)
    laid_by = (SLICE,) if heavy.table is None else ()
    laid = change.bucketed("person") if laid_by else person
    validate_unique_key(laid, (*PERSON_KEY, *laid_by), "person recode")
    # Reached only if no key is repeated.
    checks.append(("unique person key", persons, persons))
    rolled = household_rollup(laid, laid_by)
    total = Observation()
    household = change.write(
        "household",
        rolled.observe(total, F.sum("hh_size").alias("persons"), F.count(F.lit(1)).alias("rows")),
        cluster_by=("SERIAL",),
        check=expect("household rollup", lambda: total.get["rows"]),
        replace=years,
        digest=digest,
        buckets=buckets if laid_by else None,
    )
    # Every person is in one household: the sizes add up to the persons.
    in_households = total.get["persons"] or 0
    if in_households != persons:
        raise ValidationError(f"household rollup: {in_households} of {persons} persons in households")

    if laid_by:
        # Sorted once, for the join and for the files; counted as well, which keeps Spark from dropping the sort.
        order = [*laid_order(laid_by), "PERNUM"]
        laid = laid.sortWithinPartitions(*order).observe(Observation(), F.count(F.lit(1)).alias("rows"))
        household = change.bucketed("household")
    merged = join_household(laid, household, heavy, laid_by).drop(SLICE)
    with _joins_by_bucket(extract.sparkSession):
        change.write(
            "person_with_household",
            merged,
            cluster_by=() if laid_by else ("SERIAL", "PERNUM"),
            check=expect("person with household", lambda: persons),
            replace=years,
            digest=digest,
            gathered=bool(laid_by),
        )
    return checks


def published_tables(tables: StageTables) -> dict[str, DataFrame]:
    """The nine published tables by name; the three shares come from one scan of the persons."""
    parts = components.hh_components(tables.household)
    spark = tables.person.sparkSession
    path = new_location(spark, "shares")
    published.multifam_share_tables(tables.person).write.parquet(path)
    shares = spark.read.parquet(path)

    def share(breakdown: str, *groups: str) -> DataFrame:
        return shares.where(F.col("breakdown") == breakdown).select(
            F.lit(True).alias("is_multifam"), "YEAR", *groups, "weighted_count", "count", "percent"
        )

    return {
        "hhsize_by_year": published.hhsize_by_year(tables.person),
        "hh_components": parts,
        "multifam_share_by_year": share("all"),
        "hh_components_normalized": components.normalize_to_year(parts),
        "multifam_hh_count": published.multifam_hh_count(tables.household),
        "multifam_hh_percent": published.multifam_hh_percent(tables.household),
        "multifam_share_by_race": share("race_eth", "race_eth"),
        "gq_share_by_race": published.gq_share_by_race(tables.person),
        "multifam_share_by_age": share("age_bucket", "age_bucket"),
    }


def write_published(results: Mapping[str, DataFrame], folder: str) -> None:
    """Write each published table as one CSV under ``folder``, sorted by its groups."""
    measures = {"weighted_count", "count", "weighted_mean", "percent", *components.COMPONENTS}
    for name, table in results.items():
        groups = [column for column in table.columns if column not in measures]
        order = ["YEAR", *[column for column in groups if column != "YEAR"]]
        write_result_csv(table, f"{folder}/{name}", order, name in QUOTED_HEADERS)


def fit_models(tables: StageTables) -> dict[str, DataFrame]:
    """Race terms of every model variant per year.

    The population and the models' columns are written once; the models read that small table.
    """
    controls = dict.fromkeys(c for names in lpm.MODEL_CONTROLS.values() for c in names)
    frame = rent.model_population(tables.person_with_household).select(
        "YEAR", lpm.RACE, lpm.WEIGHT, "is_multifam", *controls
    )
    spark = frame.sparkSession
    path = new_location(spark, "model-frame")
    frame.write.parquet(path)
    stored = spark.read.schema(frame.schema).parquet(path)
    return {
        name: lpm.filter_by_race(lpm.run_lpm_by_year(stored, names))
        for name, names in lpm.MODEL_CONTROLS.items()
    }
