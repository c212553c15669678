"""The published tables, from person and household tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthtab.functions.recode import household_population, in_group_quarters
from hearthtab.operators.crosstab import crosstab_count, crosstab_mean, crosstab_percent

# Race groups shown in the two tables by race.
MULTIFAM_RACES = ("White", "Black", "Hispanic")
GROUP_QUARTERS_RACES = ("White", "Black", "AAPI", "Hispanic", "AIAN")


def hhsize_by_year(person: DataFrame) -> DataFrame:
    """Average size of the household a person lives in."""
    return crosstab_mean(household_population(person), "NUMPREC", "PERWT", ["YEAR"]).orderBy("YEAR")


def multifam_share_by_year(person: DataFrame) -> DataFrame:
    """Percent of persons in multifamily households."""
    table = crosstab_percent(
        household_population(person), "PERWT", ["is_multifam", "YEAR"], ["YEAR"]
    )
    return table.where("is_multifam").orderBy("YEAR")


def multifam_share_by_race(person: DataFrame) -> DataFrame:
    """The same within race groups."""
    table = crosstab_percent(
        household_population(person),
        "PERWT",
        ["is_multifam", "YEAR", "race_eth"],
        ["YEAR", "race_eth"],
    )
    shown = table.where(F.col("is_multifam") & F.col("race_eth").isin(*MULTIFAM_RACES))
    return shown.orderBy("YEAR", "race_eth")


def multifam_share_by_age(person: DataFrame) -> DataFrame:
    """The same within age groups."""
    table = crosstab_percent(
        household_population(person),
        "PERWT",
        ["is_multifam", "YEAR", "age_bucket"],
        ["YEAR", "age_bucket"],
    )
    return table.where("is_multifam").orderBy("YEAR", "age_bucket")


def multifam_share_tables(person: DataFrame) -> DataFrame:
    """The three tables above from one scan, told apart by ``breakdown``."""
    cells = (
        household_population(person)
        .groupingSets(
            [
                ["YEAR", "is_multifam"],
                ["YEAR", "is_multifam", "race_eth"],
                ["YEAR", "is_multifam", "age_bucket"],
            ],
            "YEAR",
            "is_multifam",
            "race_eth",
            "age_bucket",
        )
        .agg(
            F.grouping("race_eth").alias("all_races"),
            F.grouping("age_bucket").alias("all_ages"),
            F.sum("PERWT").alias("weight"),
            F.count("*").alias("count"),
        )
    )
    total = F.sum("weight").over(
        Window.partitionBy("all_races", "all_ages", "YEAR", "race_eth", "age_bucket")
    )
    breakdown = (
        F.when(F.col("all_races") == 0, "race_eth")
        .when(F.col("all_ages") == 0, "age_bucket")
        .otherwise("all")
    )
    percent = F.try_divide(F.lit(100.0) * F.col("weight").cast("double"), total.cast("double"))
    return (
        cells.withColumns({"breakdown": breakdown, "percent": percent})
        .where(
            F.col("is_multifam")
            & ((F.col("breakdown") != "race_eth") | F.col("race_eth").isin(*MULTIFAM_RACES))
        )
        .select(
            "breakdown",
            "YEAR",
            "race_eth",
            "age_bucket",
            F.col("weight").cast("double").alias("weighted_count"),
            "count",
            "percent",
        )
    )


def multifam_hh_count(household: DataFrame) -> DataFrame:
    """Multifamily households by number of families."""
    return crosstab_count(
        household_population(household).where("is_multifam"), "HHWT", ["n_multifam", "YEAR"]
    ).orderBy("YEAR", "n_multifam")


def multifam_hh_percent(household: DataFrame) -> DataFrame:
    """How multifamily households split by number of families."""
    return crosstab_percent(
        household_population(household).where("is_multifam"),
        "HHWT",
        ["n_multifam", "YEAR"],
        ["YEAR"],
    ).orderBy("YEAR", "n_multifam")


def gq_share_by_race(person: DataFrame) -> DataFrame:
    """Percent of persons in group quarters, within race groups."""
    table = crosstab_percent(
        person.withColumn("in_gq", in_group_quarters(F.col("GQ"))),
        "PERWT",
        ["in_gq", "YEAR", "race_eth"],
        ["YEAR", "race_eth"],
    )
    shown = table.where(F.col("in_gq") & F.col("race_eth").isin(*GROUP_QUARTERS_RACES))
    return shown.orderBy("YEAR", "race_eth")
