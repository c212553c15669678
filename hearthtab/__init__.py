"""Weighted census-microdata analytics on Spark DataFrames."""

from hearthtab.operators.crosstab import crosstab_count, crosstab_mean, crosstab_percent
from hearthtab.operators.lpm import filter_by_race, run_lpm_by_year
from hearthtab.operators.validate import validate_row_counts, validate_unique_key

__all__ = [
    "crosstab_count",
    "crosstab_mean",
    "crosstab_percent",
    "filter_by_race",
    "run_lpm_by_year",
    "validate_row_counts",
    "validate_unique_key",
]
