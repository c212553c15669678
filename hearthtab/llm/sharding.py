"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered in the order of their identifier. The number is permuted by a
Feistel network over its two digits in a mixed radix ``a * b >= n``, ``a`` and ``b``
near the square root of ``n``. A result of ``n`` or more is permuted again (cycle
walking) until it falls below ``n``; as fewer than ``a`` numbers lie outside, a second
walk is rare. The permuted number modulo the number of shards is the shard, the
quotient the slot. Both follow from the row number alone, so any place can be
computed without the table: see :func:`place_of` and :func:`row_at`.
"""

from __future__ import annotations

import math
import struct

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthtab.llm.common import pick, staged

# Round keys, two per double round. Change them for another shuffle.
ROUND_KEYS = ((11, 23), (37, 41), (59, 67), (83, 97))
# A longer walk has a probability below n * n**-32; it raises an error.
MOST_WALKS = 64
_PARTITION_BITS = 33
_SEED = 42


def permuted_number(number: str, total: str, keys=ROUND_KEYS) -> Column:
    """The permuted row number; both arguments are names of long columns.

    Needs columns ``_a`` and ``_b`` from :func:`_with_radix`.
    """
    pairs = ", ".join(f"struct({p}L AS p, {q}L AS q)" for p, q in keys)
    left = "pmod(s.l + pmod(xxhash64(s.r, k.p), _a), _a)"
    right = f"pmod(s.r + pmod(xxhash64({left}, k.q), _b), _b)"
    once = (
        f"aggregate(array({pairs}), struct(y div _b AS l, y % _b AS r), "
        f"(s, k) -> struct({left} AS l, {right} AS r), s -> s.l * _b + s.r)"
    )
    walk = (
        f"aggregate(sequence(1L, least(_a * _b - {total} + 1, {MOST_WALKS}L)), {number}, "
        f"(y, walk) -> CASE WHEN walk > 1 AND y < {total} THEN y ELSE {once} END)"
    )
    return F.expr(walk)


def _with_radix(rows: DataFrame, total: str) -> DataFrame:
    # The root is rounded up by two so that an inexact root of a long stays large enough.
    return rows.withColumn("_a", F.ceil(F.sqrt(total)).cast("long") + 2).withColumn(
        "_b", F.expr(f"({total} + _a - 1) div _a")
    )


def number_rows(rows: DataFrame, order_by: list[str]) -> DataFrame:
    """Columns ``row_number`` (from 0) and ``total`` over the whole table.

    ``order_by`` must order all rows. Range partitions are sorted each on its own and
    written; the rows before each partition come from one count per partition.
    """
    ordered = staged(
        rows.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_place", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("_part", F.shiftright("_place", _PARTITION_BITS))
    # One row per partition from here on.
    parts = Window.orderBy("_part")
    offsets = (
        ordered.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(parts) - F.col("_rows"))
        .withColumn("total", F.sum("_rows").over(Window.partitionBy()))
        .drop("_rows")
    )
    within = F.col("_place").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    return (
        ordered.join(offsets, "_part")
        .withColumn("row_number", F.col("_before") + within)
        .drop("_part", "_place", "_before")
    )


def shard_rows(
    docs: DataFrame, shards: int = 8, keys=ROUND_KEYS, id_column="doc_id", text_column="text"
) -> DataFrame:
    """Shard and slot of every row; counts of two shards differ by one at most.

    Columns: the identifier, ``size`` (UTF-8 bytes and one), ``text_crc32``, ``row_number``,
    ``shard``, ``slot``. A null text counts as empty. Null identifiers come first in the
    numbering; rows with equal identifiers are ordered by checksum, size and place in the input,
    so copies of a row are dealt out like any others and no group of them meets in a task.
    Extra columns are not read. An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = pick(docs, _id=id_column, _text=text_column).select(
        "_id",
        (F.coalesce(F.octet_length("_text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("_text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    # Written once, so that texts are read once and the tie-breaker never changes.
    numbered = number_rows(staged(rows, "sized"), ["_id", "text_crc32", "size", "_tie"])
    placed = _with_radix(numbered, "total").withColumn(
        "_new", permuted_number("row_number", "total", keys)
    )
    checked = F.when(F.col("_new") < F.col("total"), F.col("_new")).otherwise(
        F.raise_error(F.lit("a walk of the permutation was too long")).cast("long")
    )
    return placed.withColumn("_new", checked).select(
        F.col("_id").alias(id_column),
        "size",
        "text_crc32",
        "row_number",
        (F.col("_new") % shards).cast("int").alias("shard"),
        F.expr(f"_new div {shards}").alias("slot"),
    )


def _hash(value: int, key: int) -> int:
    first = xxhash.xxh64_intdigest(struct.pack("<q", value), _SEED)
    second = xxhash.xxh64_intdigest(struct.pack("<q", key), first)
    return second - (1 << 64) if second >= 1 << 63 else second


def _radix(total: int) -> tuple[int, int]:
    a = math.ceil(math.sqrt(total)) + 2
    return a, -(-total // a)


def place_of(row_number: int, total: int, shards: int = 8, keys=ROUND_KEYS) -> tuple[int, int]:
    """Shard and slot of one row number, without the table."""
    a, b = _radix(total)
    y = row_number
    while True:
        left, right = divmod(y, b)
        for p, q in keys:
            left = (left + _hash(right, p) % a) % a
            right = (right + _hash(left, q) % b) % b
        y = left * b + right
        if y < total:
            return y % shards, y // shards


def row_at(shard: int, slot: int, total: int, shards: int = 8, keys=ROUND_KEYS) -> int:
    """The row number at a place: the inverse of :func:`place_of`."""
    a, b = _radix(total)
    y = slot * shards + shard
    while True:
        left, right = divmod(y, b)
        for p, q in reversed(keys):
            right = (right - _hash(left, q) % b) % b
            left = (left - _hash(right, p) % a) % a
        y = left * b + right
        if y < total:
            return y
