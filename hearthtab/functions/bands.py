"""Banding a number by explicit break points."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiples of the step as doubles: 3 * 0.05 is slightly above 0.15, so a burden
# of exactly 0.15 belongs to the band below.
BURDEN_BREAKS = [i * 0.05 for i in range(41)]
BURDEN_LABELS = [f"{5 * i}–{5 * i + 4.9:g}" for i in range(40)]

RENT_BREAKS = [200 * i for i in range(21)]
RENT_LABELS = [f"${low}–${low + 200}" for low in RENT_BREAKS[:-1]]


def band_rank(
    value: str, breaks: Sequence[float], right: bool = False, tolerance: float = 0.0
) -> Column:
    """1-based band number of column ``value``; NULL outside the breaks.

    Bands are closed on the left and the last one on both sides; with ``right``
    they are closed on the right and the first one on both sides. ``tolerance``
    widens the closed ends, as histograms do.
    """
    last = len(breaks) - 1
    inner = "<=" if right else "<"
    shift = tolerance if right else -tolerance
    cases = [f"WHEN {value} < {_literal(breaks[0] - tolerance)} THEN NULL"]
    cases += [
        f"WHEN {value} {inner} {_literal(breaks[i] + shift)} THEN {i}" for i in range(1, last)
    ]
    cases.append(f"WHEN {value} <= {_literal(breaks[last] + tolerance)} THEN {last}")
    return F.expr(f"CASE {' '.join(cases)} END")


def _literal(number: float) -> str:
    return f"{number!r}D" if isinstance(number, float) else str(number)


def band_label(rank: str, labels: Sequence[str]) -> Column:
    """Label of the 1-based band number in column ``rank``."""
    listed = ", ".join(f"'{label}'" for label in labels)
    return F.expr(f"get(array({listed}), {rank} - 1)")


def rent_per_family(rent: Column, nfams: Column) -> Column:
    """Rent per family; NULL without a family."""
    return F.try_divide(rent.cast("double"), nfams.cast("double"))


def rent_burden(rent: Column, household_income: Column, months: int = 12) -> Column:
    """Yearly rent over household income; NULL when the income is zero."""
    return F.try_divide((rent * months).cast("double"), household_income.cast("double"))


# How far a histogram's breaks lean to round units, and how close counts as equal.
_LEAN = 1.5
_LEAN_TO_FIVE = 0.5 + 1.5 * _LEAN
_ROUNDING = 1e-10


def pretty_breaks(low: float, high: float, bins: int = 50) -> list[float]:
    """About ``bins`` + 1 equally spaced round numbers that cover ``low`` to ``high``.

    The distance is 1, 2, 5 or 10 times a power of ten. A range of one value gets breaks around it.
    """
    if bins < 1 or not (math.isfinite(low) and math.isfinite(high)) or low > high:
        raise ValueError(f"no breaks from {low} to {high} in {bins} bins")
    largest = max(abs(low), abs(high))
    cell = (high - low) / bins
    if high - low <= largest * (1 + 1 / (1 + _LEAN)) * bins * 3 * math.ulp(1.0):
        # A single value: cells of about its size, shrunk as for few bins.
        cell = (largest or 1.0) * 0.75 / (bins if bins > 1 else 1)
    power = 10.0 ** math.floor(math.log10(cell))
    unit = power
    for factor, lean in ((2, _LEAN), (5, _LEAN_TO_FIVE), (10, _LEAN)):
        if factor * power - cell >= lean * (cell - unit):
            break
        unit = factor * power
    first, last = math.floor(low / unit + _ROUNDING), math.ceil(high / unit - _ROUNDING)
    if first == last:
        first, last = first - (first * unit >= low), last + (last * unit <= high)
    return [k * unit for k in range(first, last + 1)]
