"""Checks between the stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ValidationError(ValueError):
    """A stage lost, gained or duplicated rows."""


def validate_row_counts(
    data: DataFrame, expected_count: int, step_description: str
) -> int:
    """Raise unless ``data`` has exactly ``expected_count`` rows."""
    actual = data.count()
    if actual != expected_count:
        raise ValidationError(
            f"{step_description}: expected {expected_count} rows, found {actual}"
        )
    return actual


def validate_unique_key(data: DataFrame, keys: Sequence[str], step_description: str) -> None:
    """Raise if two rows share a key."""
    repeated = data.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")
    if not repeated.isEmpty():
        raise ValidationError(f"{step_description}: key ({', '.join(keys)}) is not unique")


def distinct_count(data: DataFrame, keys: Sequence[str]) -> int:
    """Number of distinct keys, such as households among persons."""
    return data.select(*keys).distinct().count()
