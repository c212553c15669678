"""Spreading keys that hold a large part of all rows over many tasks.

A key is *heavy* when it has more than ``rows_per_task`` rows, an absolute number that
does not grow with the data. Heavy keys are found once per table and kept as a small table,
which Spark joins as it sees fit: broadcast if it is small, shuffled otherwise. Usually there
are none, and the plan stays a plain join or window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthtab.sources.workspace import new_location


@dataclass(frozen=True)
class SkewLimits:
    """``rows_per_task``: rows of one key that a task takes, whatever the size of the table."""

    rows_per_task: int = 1_000_000


@dataclass(frozen=True)
class HeavyKeys:
    """A table of heavy keys with their ``rows``, or None, and the rows a task takes."""

    table: DataFrame | None
    rows_per_task: int


DEFAULT_LIMITS = SkewLimits()
NONE_HEAVY = HeavyKeys(None, DEFAULT_LIMITS.rows_per_task)

_PARTITION_BITS = 33

# Range partitions are cut from samples that the driver gathers, about 300 rows per partition. Beyond this many,
# each takes more rows than asked for, up to ``DEFAULT_LIMITS``; a task sorts those on disk.
MOST_RANGES = 200

# Rows are counted in this many groups of keys first: these are combined in a task before they are shuffled.
KEY_GROUPS = 65_536


def find_heavy(
    rows: DataFrame, keys: Sequence[str], limits: SkewLimits = DEFAULT_LIMITS
) -> HeavyKeys:
    """Count rows per key, reading the key columns only, and keep the heavy keys as a table.

    Run it once on a stored table and pass the result on. Only keys of a group with more rows than
    the limit are counted one by one; a table smaller than the limit is not counted by key.
    """
    limit = limits.rows_per_task
    total = rows.count()
    if total <= limit:
        return HeavyKeys(None, limit)
    # With half the limit in a group on average, too many groups would exceed it.
    if total <= limit * KEY_GROUPS // 2:
        rows = rows.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(KEY_GROUPS)).alias("_group"))
        groups = rows.groupBy("_group").agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit)
        large = new_location(rows.sparkSession, "key-groups")
        groups.select("_group").write.parquet(large)
        kept = rows.sparkSession.read.schema("_group bigint").parquet(large)
        if kept.isEmpty():
            return HeavyKeys(None, limit)
        rows = rows.join(F.broadcast(kept), "_group", "left_semi")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > limit)
    path = new_location(rows.sparkSession, "heavy-keys")
    sizes.write.parquet(path)
    found = rows.sparkSession.read.schema(sizes.schema).parquet(path)
    return HeavyKeys(None if found.isEmpty() else found, limit)


def salted_join(
    rows: DataFrame,
    attributes: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    heavy: HeavyKeys,
    how: str = "left",
) -> DataFrame:
    """Join of ``rows`` to one ``attributes`` row per key.

    Rows of heavy keys are dealt over salts by a hash of ``spread_by`` and their
    attribute row is repeated once per salt; all other keys use salt 0.
    """
    keys = list(keys)
    if heavy.table is None:
        return rows.join(attributes, keys, how)
    table = heavy.table.select(
        *keys, F.ceil(F.col("rows") / heavy.rows_per_task).cast("int").alias("salts")
    )
    dealt = F.pmod(F.xxhash64(*spread_by), F.col("salts").cast("bigint")).cast("int")
    left = rows.join(table, keys, "left").withColumn("salt", F.coalesce(dealt, F.lit(0)))
    right = attributes.join(table, keys, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    )
    return left.drop("salts").join(right.drop("salts"), [*keys, "salt"], how).drop("salt")


def _ranges(total: int, rows_per_task: int) -> int:
    """Range partitions for ``total`` rows."""
    most = max(MOST_RANGES, -(-total // DEFAULT_LIMITS.rows_per_task) + 1)
    return min(-(-total // rows_per_task) + 1, most)


def number_rows(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    row_id: Sequence[str],
    number_col: str,
    size_col: str,
    heavy: HeavyKeys,
) -> DataFrame:
    """Exact ``row_number`` and row count per key, also where one key holds most rows.

    Rows of ordinary keys are numbered in a window per key. Rows of heavy keys are sorted
    by key, order and ``row_id`` over range partitions of about ``rows_per_task`` rows each, or more
    from ``MOST_RANGES`` partitions on, and written; a row's place in its partition, the sizes of
    earlier partitions and the place of its key's first row give its number. ``row_id`` makes places
    unique, so copies of one row are cut apart as well.
    """
    keys = list(keys)
    of_key = Window.partitionBy(*keys)
    columns = [c for c in rows.columns if c not in row_id]
    plain = rows
    if heavy.table is not None:
        plain = rows.join(heavy.table.select(*keys), keys, "left_anti")
    numbered = plain.select(*columns).withColumns(
        {
            number_col: F.row_number().over(of_key.orderBy(*order)),
            size_col: F.count("*").over(of_key),
        }
    )
    if heavy.table is None:
        return numbered

    many = rows.join(heavy.table.select(*keys), keys, "left_semi")
    total = heavy.table.agg(F.sum("rows")).first()[0]
    tasks = _ranges(total, heavy.rows_per_task)
    path = new_location(rows.sparkSession, "heavy-rows")
    by = [*keys, *order, *row_id]
    (
        many.repartitionByRange(tasks, *by)
        .sortWithinPartitions(*by)
        .select(*columns, F.monotonically_increasing_id().alias("_place"))
        .write.parquet(path)
    )
    placed = rows.sparkSession.read.parquet(path).withColumn(
        "_part", F.shiftright("_place", _PARTITION_BITS)
    )
    # One row per range partition from here on.
    parts = Window.orderBy("_part")
    before = placed.groupBy("_part").agg(F.count("*").alias("_rows")).select(
        "_part", (F.sum("_rows").over(parts) - F.col("_rows")).alias("_before")
    )
    within = F.col("_place").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    global_place = placed.join(before, "_part").withColumn("_global", F.col("_before") + within)
    firsts = global_place.groupBy(*keys).agg(
        F.min("_global").alias("_first"), F.count("*").alias("_size")
    )
    # Both sides come from the same few keys; the rows are dealt over salts like in any join of theirs.
    heavy_numbered = salted_join(global_place, firsts, keys, ["_global"], heavy, "inner").select(
        *columns,
        (F.col("_global") - F.col("_first") + 1).cast("int").alias(number_col),
        F.col("_size").alias(size_col),
    )
    return numbered.unionByName(heavy_numbered)
