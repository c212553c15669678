"""Stage tables that lie by household, so that rollup and merge move nothing.

The version-keeping tables of ``plans.build`` lie by survey year, which serves tables by year. Where
households are rolled up and merged again and again, such as for new recodes, persons and households are
stored in equally many buckets of the household key: each task reads a household's persons and the
household itself from its own buckets. Tables are registered in the session's catalog, which is where Spark
looks buckets up.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from hearthtab.operators.household import HOUSEHOLD_KEY, household_rollup, join_household
from hearthtab.operators.skew import DEFAULT_LIMITS, SkewLimits, find_heavy

# Spark takes no more buckets than this.
MOST_BUCKETS = 100_000


@dataclass(frozen=True)
class HouseholdTables:
    """Names of the stored tables, the tables, and the merge of both, which is computed when read."""

    person_name: str
    household_name: str
    person: DataFrame
    household: DataFrame
    person_with_household: DataFrame


def store_bucketed(
    data: DataFrame,
    name: str,
    path: str,
    buckets: int,
    keys: Sequence[str] = HOUSEHOLD_KEY,
    spread: bool = True,
) -> DataFrame:
    """A table of the catalog with its rows in one file per bucket, sorted by the keys.

    With ``spread`` rows are first moved to their buckets; rows that come from tables of as many buckets of
    these keys are there already.
    """
    moved = data.repartition(buckets, *keys) if spread else data
    (
        moved.write.bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", path)
        .format("parquet")
        .saveAsTable(name)
    )
    return data.sparkSession.table(name)


def store_households(
    person: DataFrame,
    folder: str,
    buckets: int | None = None,
    limits: SkewLimits = DEFAULT_LIMITS,
) -> HouseholdTables:
    """Store recoded persons and their households side by side.

    Persons are shuffled once, while they are stored; the rollup and every merge after that read without a
    shuffle. ``buckets`` is the number of shuffle partitions unless given: take enough that a bucket of
    persons fits a task. Households of more than ``limits`` rows are still dealt over tasks by the merge.
    """
    spark = person.sparkSession
    buckets = min(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    mark = uuid.uuid4().hex
    names = [f"hearthtab_{table}_{mark}" for table in ("person", "household")]
    persons = store_bucketed(person, names[0], f"{folder}/person", buckets)
    households = store_bucketed(
        household_rollup(persons), names[1], f"{folder}/household", buckets, spread=False
    )
    heavy = find_heavy(persons.select(*HOUSEHOLD_KEY), HOUSEHOLD_KEY, limits)
    return HouseholdTables(*names, persons, households, join_household(persons, households, heavy))
