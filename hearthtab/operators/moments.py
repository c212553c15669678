"""Weighted means and centred products that are gathered in one pass and can be merged.

Each task keeps, per cell, the number of rows, the weight, the weighted mean of every value and the sums of
products of deviations from these means. Two such records merge without going back to the rows: the
products are moved to the common mean. A mean far above the spread therefore costs no digits, nothing is
read twice, and stored moments take in a new survey year by adding its records.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS, WEIGHT, MEANS, PRODUCTS = "rows", "weight", "means", "products"


def place(a: int, b: int, size: int) -> int:
    """Index of the pair in the upper triangle of a ``size`` by ``size`` matrix, row by row."""
    a, b = min(a, b), max(a, b)
    return a * size - a * (a - 1) // 2 + b - a


def _merged(one: tuple, two: tuple) -> tuple:
    """Records (rows, weight, means, products) of two parts to that of both."""
    if one[1] == 0 or two[1] == 0:
        rest = two if one[1] == 0 else one
        return (one[0] + two[0], *rest[1:])
    weight = one[1] + two[1]
    apart = two[2] - one[2]
    means = one[2] + apart * (two[1] / weight)
    products = one[3] + two[3] + np.outer(apart, apart) * (one[1] * two[1] / weight)
    return one[0] + two[0], weight, means, products


def _records(batch: pa.RecordBatch, keys: Sequence[str], values: Sequence[str], weight: str) -> dict[tuple, tuple]:
    """Cell to its record, for the rows of one batch."""
    code = np.zeros(batch.num_rows, np.int64)
    for key in keys:
        codes = pc.fill_null(pc.dictionary_encode(batch[key]).indices, -1)
        own = np.asarray(codes).astype(np.int64) + 1
        # Renumbered after each key, so that codes never outgrow the number of rows.
        code = np.unique(code * (int(own.max()) + 1) + own, return_inverse=True)[1]
    n = int(code.max()) + 1
    first = np.full(n, batch.num_rows)
    np.minimum.at(first, code, np.arange(batch.num_rows))
    weights = batch[weight].to_numpy(zero_copy_only=False).astype(float)
    known = ~np.isnan(weights)
    code, weights = code[known], weights[known]
    z = np.stack([batch[v].to_numpy(zero_copy_only=False).astype(float)[known] for v in values])
    rows = np.bincount(code, minlength=n)
    total = np.bincount(code, weights=weights, minlength=n)
    means = np.stack([np.bincount(code, weights=weights * v, minlength=n) for v in z]) / np.where(total > 0, total, 1)
    # A second step takes away what rounding left of the mean.
    off = z - means[:, code]
    rest = np.stack([np.bincount(code, weights=weights * v, minlength=n) for v in off]) / np.where(total > 0, total, 1)
    means, off = means + rest, off - rest[:, code]
    products = np.empty((n, len(values), len(values)))
    for a in range(len(values)):
        for b in range(a, len(values)):
            products[:, a, b] = products[:, b, a] = np.bincount(code, weights=weights * off[a] * off[b], minlength=n)
    names = [batch[key].take(pa.array(first)).to_pylist() for key in keys]
    return {
        cell: (int(rows[k]), float(total[k]), means[:, k], products[k]) for k, cell in enumerate(zip(*names))
    }


def gather(
    data: DataFrame, keys: Sequence[str], values: Sequence[str], weight: str
) -> DataFrame:
    """One record per task and cell: keys, rows, weight, means, products (upper triangle).

    Rows without weight count as no rows, but their cell appears. Values are known where the weight is.
    """
    size = len(values)
    upper = np.triu_indices(size)
    key_fields = [data.schema[key] for key in keys]
    schema = T.StructType(key_fields)
    for name, kind in (
        (ROWS, T.LongType()), (WEIGHT, T.DoubleType()),
        (MEANS, T.ArrayType(T.DoubleType())), (PRODUCTS, T.ArrayType(T.DoubleType())),
    ):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        types = None
        for batch in batches:
            types = [batch.schema.field(key).type for key in keys]
            if batch.num_rows:
                for cell, record in _records(batch, keys, values, weight).items():
                    held[cell] = _merged(held[cell], record) if cell in held else record
        if held:
            cells, records = list(held), list(held.values())
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array([cell[k] for cell in cells], kind) for k, kind in enumerate(types)],
                    pa.array([r[0] for r in records], pa.int64()),
                    pa.array([r[1] for r in records], pa.float64()),
                    pa.array([r[2].tolist() for r in records], pa.list_(pa.float64())),
                    pa.array([r[3][upper].tolist() for r in records], pa.list_(pa.float64())),
                ],
                names=schema.names,
            )

    return data.select(*keys, weight, *values).mapInArrow(run, schema)


def mean(k: int) -> Column:
    return F.get(F.col(MEANS), F.lit(k))


def product(a: int, b: int, size: int) -> Column:
    return F.get(F.col(PRODUCTS), F.lit(place(a, b, size)))


def merge(records: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """One record per cell from any number of them, such as those of tasks, or of stored years and a new one."""
    cell = Window.partitionBy(*keys)
    weight = F.col(WEIGHT)
    centred = records.withColumns(
        {f"c_{k}": F.try_divide(F.sum(weight * mean(k)).over(cell), F.sum(weight).over(cell)) for k in range(size)}
    )
    moved = [
        F.sum(product(a, b, size) + weight * (mean(a) - F.col(f"c_{a}")) * (mean(b) - F.col(f"c_{b}")))
        for a in range(size)
        for b in range(a, size)
    ]
    return centred.groupBy(*keys).agg(
        F.sum(ROWS).alias(ROWS),
        F.sum(WEIGHT).alias(WEIGHT),
        F.array(*[F.coalesce(F.max(f"c_{k}"), F.lit(0.0)) for k in range(size)]).alias(MEANS),
        F.array(*[F.coalesce(m, F.lit(0.0)) for m in moved]).alias(PRODUCTS),
    )
