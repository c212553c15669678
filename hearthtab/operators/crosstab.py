"""Weighted cross tables.

Every table is one partial-then-final aggregation: rows are combined in their own
tasks first, so a group holding most of the data costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mean(value: str, wt_col: str) -> Column:
    """Weighted mean over the rows where both value and weight are known."""
    known = F.col(value).isNotNull()
    numerator = F.sum(F.col(wt_col) * F.col(value)).cast("double")
    denominator = F.sum(F.when(known, F.col(wt_col))).cast("double")
    return F.try_divide(numerator, denominator)


def crosstab_count(data: DataFrame, wt_col: str, group_by: Sequence[str]) -> DataFrame:
    """Weighted and plain row count per group; NULL is a group of its own."""
    return data.groupBy(*group_by).agg(
        F.sum(wt_col).cast("double").alias("weighted_count"),
        F.count("*").alias("count"),
    )


def crosstab_mean(
    data: DataFrame, value: str, wt_col: str, group_by: Sequence[str]
) -> DataFrame:
    """Counts as in ``crosstab_count`` and the weighted mean of ``value``.

    Rows without a value stay in both counts but not in the mean.
    """
    return data.groupBy(*group_by).agg(
        F.sum(wt_col).cast("double").alias("weighted_count"),
        F.count("*").alias("count"),
        weighted_mean(value, wt_col).alias("weighted_mean"),
    )


def with_percent(
    counts: DataFrame,
    percent_group_by: Sequence[str],
    count_col: str = "weighted_count",
    total: Column | None = None,
) -> DataFrame:
    """Add each cell's share of its ``percent_group_by`` total, in percent.

    Totals are aggregated with partial sums and joined back NULL-safely, so that no task
    needs all cells of a group, however fine the cells are. ``total`` is the sum of ``count_col`` in
    another form.
    """
    groups = list(percent_group_by)
    summed = F.sum(count_col) if total is None else total
    totals = counts.groupBy(*groups).agg(summed.alias("_total"))
    names = [f"_of_{k}" for k in range(len(groups))]
    renamed = totals.toDF(*names, "_total")
    if groups:
        same = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(groups, names, strict=True)]
        joined = counts.join(renamed, reduce(and_, same))
    else:
        # One row.
        joined = counts.join(F.broadcast(renamed))
    share = F.try_divide(F.lit(100.0) * F.col(count_col).cast("double"), F.col("_total").cast("double"))
    return joined.select(*counts.columns, share.alias("percent"))


def crosstab_percent(
    data: DataFrame,
    wt_col: str,
    group_by: Sequence[str],
    percent_group_by: Sequence[str],
) -> DataFrame:
    """Counts as in ``crosstab_count`` and the percentage within ``percent_group_by``.

    NULL groups stay in the denominator. Filter before the call to change the
    denominator, after it to drop cells only.
    """
    outside = set(percent_group_by) - set(group_by)
    if outside:
        raise ValueError(f"percent_group_by must be part of group_by, not {sorted(outside)}")
    cells = data.groupBy(*group_by).agg(
        F.sum(wt_col).alias("weighted_count"), F.count("*").alias("count")
    )
    # The totals read the count as well, which is never 0: both sides of the join then need the same cells, so
    # that the data are scanned and shuffled once.
    total = F.sum(F.when(F.col("count") > 0, F.col("weighted_count")))
    return with_percent(cells, percent_group_by, total=total).withColumn(
        "weighted_count", F.col("weighted_count").cast("double")
    )
