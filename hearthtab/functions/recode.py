"""Row-wise recodes of census codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quarters codes of the household population, and the first code
# of group quarters. Code 5 belongs to neither the first nor to households.
HOUSEHOLD_GQ = (0, 1, 2)
FIRST_GROUP_QUARTERS_CODE = 3

# Derived column, the columns it needs, and its rule. A code no branch names is NULL.
# - five or more families count as five; a studio (code 2) counts as one bedroom
# - the fourth age label says 65 although the group ends at 64
# - Hispanic wins over race; unknown Hispanic origin falls through to race
# Groups used in filters come straight from the codes, so that a filter pushed to the
# scan stays short.
PERSON_RECODES = (
    (
        "n_multifam",
        ("NFAMS",),
        "CASE WHEN NFAMS BETWEEN 0 AND 4 THEN NFAMS WHEN NFAMS >= 5 THEN 5 END",
    ),
    (
        "is_multifam",
        ("NFAMS",),
        "CASE WHEN NFAMS = 1 THEN FALSE WHEN NFAMS >= 2 THEN TRUE END",
    ),
    ("room", ("ROOMS",), "CASE WHEN ROOMS < 9 THEN ROOMS WHEN ROOMS >= 9 THEN 9 END"),
    (
        "bedroom",
        ("BEDROOMS",),
        "CASE WHEN BEDROOMS = 1 THEN 1 WHEN BEDROOMS BETWEEN 2 AND 5 THEN BEDROOMS - 1 "
        "WHEN BEDROOMS >= 6 THEN 5 END",
    ),
    (
        "ppbr",
        ("NUMPREC", "BEDROOMS"),
        "try_divide(CAST(NUMPREC AS DOUBLE), CAST(bedroom AS DOUBLE))",
    ),
    (
        "age_bucket",
        ("AGE",),
        "CASE WHEN AGE < 18 THEN '17 or younger' WHEN AGE < 30 THEN '18-29' "
        "WHEN AGE < 50 THEN '30-49' WHEN AGE < 65 THEN '50-65' "
        "WHEN AGE >= 65 THEN '65 and older' END",
    ),
    (
        "is_hispan",
        ("HISPAN",),
        "CASE WHEN HISPAN = 0 THEN FALSE WHEN HISPAN BETWEEN 1 AND 4 THEN TRUE END",
    ),
    (
        "race_bucket",
        ("RACE",),
        "CASE WHEN RACE = 1 THEN 'white' WHEN RACE = 2 THEN 'black' WHEN RACE = 3 THEN 'aian' "
        "WHEN RACE BETWEEN 4 AND 6 THEN 'aapi' WHEN RACE = 7 THEN 'other' "
        "WHEN RACE IN (8, 9) THEN 'multi' END",
    ),
    (
        "race_eth",
        ("HISPAN", "RACE"),
        "CASE WHEN HISPAN BETWEEN 1 AND 4 THEN 'Hispanic' WHEN RACE = 1 THEN 'White' "
        "WHEN RACE = 2 THEN 'Black' WHEN RACE = 3 THEN 'AIAN' WHEN RACE BETWEEN 4 AND 6 THEN 'AAPI' "
        "WHEN RACE = 7 THEN 'Other' WHEN RACE IN (8, 9) THEN 'Multiracial' END",
    ),
)


def in_group_quarters(gq: Column) -> Column:
    return gq >= FIRST_GROUP_QUARTERS_CODE


def capped(count: Column, cap: int) -> Column:
    """``count`` with everything from ``cap`` up lumped together; NULL stays NULL."""
    return F.when(count >= cap, F.lit(cap)).otherwise(count).cast("int")


def household_population(df: DataFrame) -> DataFrame:
    return df.where(F.col("GQ").isin(*HOUSEHOLD_GQ))


def recode_person(df: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Add the derived person columns, except income, that are not there yet.

    Inputs are found whatever their case and get the variable's own spelling. A missing input is an
    error; with ``allow_missing`` the columns that need it are left out. A rule may use
    columns derived before it.
    """
    derived = {name for name, _, _ in PERSON_RECODES}
    inputs = {i for _, names, _ in PERSON_RECODES for i in names} - derived
    spelled = {
        c: c.upper() for c in df.columns if c != c.upper() and c.upper() in inputs - set(df.columns)
    }
    df = df.withColumnsRenamed(spelled)
    present = set(df.columns)
    missing = sorted(inputs - present)
    if missing and not allow_missing:
        raise ValueError(f"the extract has no {', '.join(missing)}")
    added = [
        f"{rule} AS {name}"
        for name, names, rule in PERSON_RECODES
        if name not in present and set(names) <= present
    ]
    return df.selectExpr("*", *added)
