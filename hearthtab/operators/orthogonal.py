"""Weighted least squares per year by triangular blocks, for controls that are nearly collinear.

Sums of products square a column's relative length: what is left of a control after the earlier ones are
taken out, in parts of its own length, cannot be told from rounding below 1e-6. Here each task turns its rows
into a triangular block with the same products (QR), blocks are stacked and turned into one again, in two
steps, and the last block of a year is solved. Nothing is squared, so that relative lengths down to 1e-10
count. A block has one row and column per term, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Groups of tasks whose blocks are merged before the year's last merge.
MERGE_GROUPS = 64
# A column is collinear with earlier ones if less than this part of its length is left.
COLLINEAR = 1e-10
# A fit is perfect if less than this part of the outcome's length is left.
PERFECT = 1e-12
# Rows that are turned into a block at a time.
_ROWS = 4096

BLOCK_SCHEMA = (
    "YEAR int, part int, rows long, baseline string, slots array<int>, terms array<string>, block array<double>"
)
Terms = list[tuple[int, str]]


def _triangular(block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block, mode="r") if len(block) else block


def _aligned(terms: Terms, block: np.ndarray, wanted: Terms) -> np.ndarray:
    out = np.zeros((len(block), len(wanted)))
    place = {term: k for k, term in enumerate(wanted)}
    out[:, [place[t] for t in terms]] = block
    return out


def merge(parts: Sequence[tuple[Terms, np.ndarray]]) -> tuple[Terms, np.ndarray]:
    """One triangular block with the products of all parts."""
    wanted = sorted({term for terms, _ in parts for term in terms})
    return wanted, _triangular(np.vstack([_aligned(terms, block, wanted) for terms, block in parts]))


def _design(rows: pd.DataFrame, race: str, categories, numbers, outcome, controls) -> tuple[Terms, np.ndarray]:
    """Terms and weighted values: races, levels of text controls, numeric controls, the outcome."""
    terms: Terms = []
    columns = []
    for slot, name in enumerate([race, *controls, outcome]):
        if name == race or name in categories:
            for level in sorted(rows[name].unique()):
                terms.append((slot, f"{name}{level}"))
                columns.append((rows[name] == level).to_numpy(float))
        else:
            terms.append((slot, name))
            columns.append(rows[name].to_numpy(float))
    order = sorted(range(len(terms)), key=terms.__getitem__)
    weight = np.sqrt(rows["w"].to_numpy(float))
    return [terms[k] for k in order], np.column_stack([columns[k] * weight for k in order])


def blocks(
    prepared: DataFrame, race: str, categories: Sequence[str], numbers: Sequence[str], outcome: str, controls: Sequence[str]
) -> DataFrame:
    """One triangular block per task and year.

    ``prepared`` has YEAR, the race, text controls, ``w`` and ``z_1`` ... for numeric controls and outcome; rows
    without ``w`` count for the baseline only.
    """
    names = {f"z_{k}": n for k, n in enumerate([*numbers, outcome], 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Terms, np.ndarray]] = {}
        count: dict[int, int] = {}
        baseline: dict[int, str] = {}
        for batch in batches:
            for year, rows in batch.to_pandas().rename(columns=names).groupby("YEAR"):
                year = int(year)
                baseline[year] = min(baseline.get(year, rows[race].min()), rows[race].min())
                rows = rows[rows["w"].notna()]
                for at in range(0, len(rows), _ROWS):
                    part = rows.iloc[at : at + _ROWS]
                    own = _design(part, race, categories, numbers, outcome, controls)
                    held[year] = merge([held[year], own]) if year in held else merge([own])
                    count[year] = count.get(year, 0) + len(part)
        if baseline:
            years = sorted(baseline)
            empty: tuple[Terms, np.ndarray] = ([], np.zeros((0, 0)))
            yield pa.RecordBatch.from_pydict(
                {
                    "YEAR": pa.array(years, pa.int32()),
                    "part": pa.array([TaskContext.get().partitionId() % MERGE_GROUPS] * len(years), pa.int32()),
                    "rows": pa.array([count.get(y, 0) for y in years], pa.int64()),
                    "baseline": pa.array([baseline[y] for y in years], pa.string()),
                    "slots": pa.array([[s for s, _ in held.get(y, empty)[0]] for y in years], pa.list_(pa.int32())),
                    "terms": pa.array([[t for _, t in held.get(y, empty)[0]] for y in years], pa.list_(pa.string())),
                    "block": pa.array([held.get(y, empty)[1].ravel().tolist() for y in years], pa.list_(pa.float64())),
                }
            )

    return prepared.select("YEAR", race, *categories, "w", *names).mapInArrow(run, BLOCK_SCHEMA)


def _parts(rows: pd.DataFrame) -> list[tuple[Terms, np.ndarray]]:
    found = []
    for slots, terms, block in zip(rows["slots"], rows["terms"], rows["block"], strict=True):
        if len(terms):
            found.append((list(zip(map(int, slots), terms, strict=True)), np.asarray(block).reshape(-1, len(terms))))
    return found


def merge_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """Blocks of a year and group as one row."""
    parts = _parts(rows)
    terms, block = merge(parts) if parts else ([], np.zeros((0, 0)))
    return pd.DataFrame(
        {
            "YEAR": [int(rows["YEAR"].iloc[0])],
            "part": [int(rows["part"].iloc[0])],
            "rows": [int(rows["rows"].sum())],
            "baseline": [rows["baseline"].min()],
            "slots": [[s for s, _ in terms]],
            "terms": [[t for _, t in terms]],
            "block": [block.ravel().tolist()],
        }
    )


def solve(terms: Terms, block: np.ndarray, categories_at: Sequence[int], rows: int):
    """Terms, estimates, standard errors and degrees of freedom; a collinear term has neither of the two."""
    # Treatment coding: the first level of each text control is the one the others are compared with.
    dropped = {min(t for t in terms if t[0] == slot) for slot in categories_at if any(t[0] == slot for t in terms)}
    wanted = [t for t in terms if t not in dropped]
    block = block[:, [k for k, t in enumerate(terms) if t not in dropped]]
    # Equal lengths, so that units do not decide what is collinear.
    length = np.sqrt((block * block).sum(axis=0))
    scale = np.where(length > 0, length, 1.0)
    unit = block / scale
    last = len(wanted) - 1
    kept: list[int] = []
    for k in range(last):
        left = np.abs(_triangular(unit[:, [*kept, k]])[len(kept), len(kept)]) if len(unit) > len(kept) else 0.0
        if length[k] > 0 and left > COLLINEAR:
            kept.append(k)
    triangle = _triangular(unit[:, [*kept, last]])
    n = len(kept)
    square = triangle[:n, :n]
    inverse = np.linalg.solve(square, np.eye(n))
    outcome = triangle[:n, n] * scale[last]
    residual = float(triangle[n, n] * scale[last]) ** 2 if len(triangle) > n else 0.0
    if residual < (PERFECT * length[last]) ** 2 * max(rows, 1):
        residual = 0.0
    freedom = rows - n
    estimate, error = np.full(last, np.nan), np.full(last, np.nan)
    estimate[kept] = inverse @ outcome / scale[kept]
    if freedom > 0:
        error[kept] = np.sqrt((inverse * inverse).sum(axis=1) * residual / freedom) / scale[kept]
    return [t for _, t in wanted[:last]], estimate, error, freedom


def fit(
    prepared: DataFrame, race: str, categories: Sequence[str], numbers: Sequence[str], outcome: str,
    controls: Sequence[str], result_schema: str, two_sided_p,
) -> DataFrame:
    """Coefficient rows per year."""
    categories_at = [1 + list(controls).index(c) for c in categories]

    def solve_year(rows: pd.DataFrame) -> pd.DataFrame:
        terms, estimate, error, freedom = solve(*merge(_parts(rows)), categories_at, int(rows["rows"].sum()))
        with np.errstate(divide="ignore", invalid="ignore"):
            statistic = estimate / error
        statistic[~np.isfinite(statistic)] = np.nan
        return pd.DataFrame(
            {
                "term": terms,
                "estimate": estimate,
                "std_error": error,
                "statistic": statistic,
                "p_value": [two_sided_p(t, freedom) for t in statistic],
                "YEAR": int(rows["YEAR"].iloc[0]),
                "baseline": rows["baseline"].min(),
            }
        )

    found = blocks(prepared, race, categories, numbers, outcome, controls)
    merged = found.groupBy("YEAR", "part").applyInPandas(merge_rows, BLOCK_SCHEMA)
    # A year without complete rows has no result.
    complete = F.sum("rows").over(Window.partitionBy("YEAR")) > 0
    known = merged.withColumn("complete", complete).where("complete").drop("complete")
    return known.groupBy("YEAR").applyInPandas(solve_year, result_schema)
