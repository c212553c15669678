"""From persons to households and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthtab.operators.skew import HeavyKeys, salted_join

# The number first: it sorts faster than the year, which has few values.
HOUSEHOLD_KEY = ("SERIAL", "YEAR")
PERSON_KEY = ("YEAR", "SERIAL", "PERNUM")
ADULT_AGE = 18

# Relationship codes counted per household. In-laws count as parents;
# the reference person (1) and institutional inmates (13) are counted nowhere.
RELATIONSHIP_CODES = {
    "n_spouse": (2,),
    "n_child": (3,),
    "n_parent": (5, 6),
    "n_grandchild": (9,),
    "n_other_rel": (4, 7, 8, 10),
    "n_non_rel": (11, 12),
}

INCOME_COLUMN = "hhinc_harmonized"

# Same for everyone in a household; taken from its first person.
HOUSEHOLD_CONSTANTS = ("NUMPREC", "room", "bedroom", "GQ", "HHWT")


# Counts stay NULL where the code is unknown for every person of the household.
HOUSEHOLD_COLUMNS = {
    "hh_size": "count(*)",
    **{name: f"min_by({name}, PERNUM)" for name in HOUSEHOLD_CONSTANTS},
    "n_multifam": "max(n_multifam)",
    "is_multifam": "max(is_multifam)",
    "hhinc_harmonized": "CAST(sum(inctot_harmonized) AS DOUBLE)",
    "n_adults": f"sum(CAST(AGE >= {ADULT_AGE} AS INT))",
    "n_children": f"sum(CAST(AGE < {ADULT_AGE} AS INT))",
    **{
        name: f"sum(CAST(RELATE IN ({', '.join(map(str, codes))}) AS INT))"
        for name, codes in RELATIONSHIP_CODES.items()
    },
}


def _household_columns(
    person: DataFrame, suffix: dict[str, str] | None = None
) -> list[Column]:
    names = suffix or {}
    return [
        F.expr(f"{text} AS {names.get(name, name)}")
        for name, text in HOUSEHOLD_COLUMNS.items()
        if name != INCOME_COLUMN or "inctot_harmonized" in person.columns
    ]


def household_rollup(person: DataFrame, laid_by: Sequence[str] = ()) -> DataFrame:
    """One row per household from recoded persons.

    Household income is summed if the persons have harmonized income. ``laid_by`` names columns that follow
    from the household key and by which the persons lie in buckets: the rollup keeps them and needs no shuffle.
    """
    return person.groupBy(*HOUSEHOLD_KEY, *laid_by).agg(*_household_columns(person))


def join_household(
    person: DataFrame, household: DataFrame, heavy: HeavyKeys, laid_by: Sequence[str] = ()
) -> DataFrame:
    """Persons with their household's columns; shared names get ``_hh``.

    ``heavy`` names households too large for one task; look them up once on a stored table. ``laid_by`` names
    columns of both tables that follow from the household key, such as what they lie in buckets by. Such tables
    are joined by ``laid_order``, so persons sorted by it stay sorted and are not sorted again.
    """
    keys = laid_order(laid_by) if laid_by else [*HOUSEHOLD_KEY]
    shared = [c for c in household.columns if c in person.columns and c not in keys]
    renamed = household.withColumnsRenamed({name: f"{name}_hh" for name in shared})
    merged = salted_join(person, renamed, keys, ["PERNUM"], heavy)
    if not laid_by:
        return merged
    others = [f"`{c}`" for c in merged.columns if c not in keys]
    return merged.select(*HOUSEHOLD_KEY, *laid_by, *others)


def laid_order(laid_by: Sequence[str]) -> list[str]:
    """The household key and ``laid_by`` in the order of the stages' files, which lie by year."""
    return [*reversed(HOUSEHOLD_KEY), *laid_by]


def reference_persons(person: DataFrame) -> DataFrame:
    """Reference persons (PERNUM 1) with their raw codes and household columns.

    The same rows as joining households to persons and keeping the first person,
    but in one aggregation: persons are read and shuffled once, and the raw codes
    are numbers, which keeps the aggregation hash-based. Recode the result with
    ``recode_person``.
    """
    text = {f.name for f in person.schema.fields if isinstance(f.dataType, T.StringType)}
    own = [name for name in person.columns if name not in HOUSEHOLD_KEY and name not in text]
    first = [
        F.expr(f"max(CASE WHEN PERNUM = 1 THEN {name} END) AS {name}") for name in own
    ]
    shared = {name: f"{name}_hh" for name in HOUSEHOLD_COLUMNS if name in own}
    rolled = person.groupBy(*HOUSEHOLD_KEY).agg(*first, *_household_columns(person, shared))
    return rolled.where("PERNUM = 1")
