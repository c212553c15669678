"""Average household composition per year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthtab.functions.recode import household_population
from hearthtab.operators.crosstab import crosstab_mean, weighted_mean

BASE_YEAR = 2023

# Components, in table order, with their labels in an indexed chart.
COMPONENT_LABELS = {
    "n_spouse": "Spouse",
    "n_child": "Child",
    "n_parent": "Parent",
    "n_grandchild": "Grandchild",
    "n_other_rel": "Other relative",
    "n_non_rel": "Non-relative",
}
COMPONENTS = tuple(COMPONENT_LABELS)

# Components in stacking order with their labels in a stacked chart.
STACKED_LABELS = {
    "n_non_rel": "Non-relatives",
    "n_other_rel": "Other relatives",
    "n_parent": "Parents / in-laws",
    "n_grandchild": "Grandchildren",
    "n_child": "Children",
    "n_spouse": "Spouse",
    "reference_person": "Reference person",
}


def get_component_mean(household: DataFrame, var: str, wt_col: str = "HHWT") -> DataFrame:
    """Average of one component per year in the household population."""
    table = crosstab_mean(household_population(household), var, wt_col, ["YEAR"])
    return table.select("YEAR", F.col("weighted_mean").alias(var))


def hh_components(household: DataFrame, wt_col: str = "HHWT") -> DataFrame:
    """Averages of all components per year, in one aggregation."""
    return (
        household_population(household)
        .groupBy("YEAR")
        .agg(*[weighted_mean(name, wt_col).alias(name) for name in COMPONENTS])
    )


def hh_components_long(components: DataFrame) -> DataFrame:
    """One row per year and component, the reference person added, in stacking order."""
    names = F.array(*[F.lit(name) for name in STACKED_LABELS])
    labels = F.array(*[F.lit(label) for label in STACKED_LABELS.values()])
    columns = [*COMPONENTS, "reference_person"]
    return (
        components.withColumn("reference_person", F.lit(1.0))
        .unpivot(["YEAR"], columns, "component", "value")
        .withColumn("rank", F.array_position(names, F.col("component")).cast("int"))
        .withColumn("label", F.get(labels, F.col("rank") - 1))
        .select("YEAR", "component", "label", "rank", "value")
    )


def normalize_to_year(components: DataFrame, base_year: int = BASE_YEAR) -> DataFrame:
    """Every component relative to its value in ``base_year``.

    Fails if the base year is missing. The window runs over one row per year.
    """
    years = Window.partitionBy(F.lit(0))
    has_base = F.max(F.col("YEAR") == base_year).over(years)
    with_base = components.withColumns(
        {
            "has_base": has_base,
            **{
                f"{name}_base": F.max(F.when(F.col("YEAR") == base_year, F.col(name))).over(years)
                for name in COMPONENTS
            },
        }
    )
    missing = F.raise_error(F.lit(f"no rows for base year {base_year}")).cast("double")
    return with_base.select(
        "YEAR",
        *[
            F.try_divide(
                F.col(name), F.when(F.col("has_base"), F.col(f"{name}_base")).otherwise(missing)
            ).alias(name)
            for name in COMPONENTS
        ],
    )


def hh_components_normalized_long(normalized: DataFrame) -> DataFrame:
    """Indexed components, one row per year and component, with labels."""
    names = F.array(*[F.lit(name) for name in COMPONENTS])
    labels = F.array(*[F.lit(label) for label in COMPONENT_LABELS.values()])
    place = F.array_position(names, F.col("component")).cast("int")
    return normalized.unpivot(
        ["YEAR"], list(COMPONENTS), "component", "relative_value"
    ).withColumn("label", F.get(labels, place - 1))
