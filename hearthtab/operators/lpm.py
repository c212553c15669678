"""Weighted linear probability models, one per year, for all years in one job.

Rows are reduced to weighted moments per (year, race, text controls) before
anything is shuffled; the regression of each year is then solved from its
cross-product sums, a few dozen numbers per year. Numeric controls are centred on
their weighted mean of the year, so that a large mean costs no digits; the race terms
are moved back afterwards. Rows are read once: each task centres on its own means, and
its moments are moved to the year's mean when they are merged. Text controls of many levels give levels squared sums per
year, which one task solves.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthtab.operators import moments, orthogonal
from hearthtab.sources.shipping import ship_package

RACE = "race_eth"
WEIGHT = "PERWT"
ROWS_TERM = "(rows)"
CENTRE_TERM = "(centre)"

# Race terms shown, in legend order.
SHOWN_RACES = ("Hispanic", "AIAN", "AAPI", "Black", "White")

# Controls of the model variants. Education enters as a number, as published.
MODEL_CONTROLS = {
    "base": (),
    "child": ("n_child",),
    "demo": ("age_bucket", "SEX"),
    "ses": ("age_bucket", "SEX", "hhinc_harmonized", "EDUC"),
}

RESULT_SCHEMA = (
    "term string, estimate double, std_error double, statistic double, p_value double, "
    "YEAR int, baseline string"
)

# A centred column is collinear with earlier ones when less than this part of its squared
# length is left after removing them, and constant when less of the uncentred one is.
_COLLINEAR = 1e-12
_CONSTANT = 1e-24
# Degrees of freedom from which p-values come from the normal distribution with a correction.
_MANY = 1e4
# A fit is perfect when less than this part of the outcome's squares is left.
_PERFECT = 1e-12


def _split_controls(data: DataFrame, controls: Sequence[str]) -> tuple[list[str], list[str]]:
    """Controls that are categories, and controls that enter as numbers."""
    categories = [
        c for c in controls if isinstance(data.schema[c].dataType, T.StringType | T.BooleanType)
    ]
    return categories, [c for c in controls if c not in categories]


def _moment(a: int, b: int) -> str:
    return f"m_{min(a, b)}_{max(a, b)}"


def _prepared(
    data: DataFrame, categories: Sequence[str], numbers: Sequence[str], outcome: str
) -> DataFrame:
    """Year, race, text controls, weight ``w`` and values ``z_*``: 1, numeric controls, outcome.

    Rows with an unknown control or no weight have no ``w`` and count for the baseline only.
    """
    known = (
        F.col(outcome).isNotNull() & F.col(RACE).isNotNull() & F.col(WEIGHT).isNotNull()
    )
    complete = F.col(WEIGHT) > 0
    for control in [*categories, *numbers]:
        complete = complete & F.col(control).isNotNull()
    values = [F.lit(1.0), *(F.col(c).cast("double") for c in [*numbers, outcome])]
    return data.where(known).select(
        "YEAR",
        RACE,
        *[F.upper(F.col(c).cast("string")).alias(c) if _is_boolean(data, c) else F.col(c)
          for c in categories],
        F.when(complete, F.col(WEIGHT).cast("double")).alias("w"),
        *[value.alias(f"z_{k}") for k, value in enumerate(values)],
    )


def _cells(prepared: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Weighted moments of 1, the numeric controls and the outcome per cell."""
    names = [c for c in prepared.columns if c.startswith("z_")]
    moments = [
        F.sum(F.col("w") * F.col(names[a]) * F.col(names[b])).alias(_moment(a, b))
        for a in range(len(names))
        for b in range(a, len(names))
    ]
    return prepared.groupBy("YEAR", RACE, *categories).agg(
        F.count("w").alias("rows"), *moments
    )


def _is_boolean(data: DataFrame, column: str) -> bool:
    return isinstance(data.schema[column].dataType, T.BooleanType)


def lpm_sufficient_stats(
    data: DataFrame, controls: Sequence[str] = (), outcome: str = "is_multifam"
) -> DataFrame:
    """Weighted cross products of every pair of model terms per year.

    Terms are a dummy per race, treatment-coded dummies of text controls (the
    alphabetically first level present is left out), numeric controls and the
    outcome. ``(rows)`` holds the number of complete rows.
    """
    categories, numbers = _split_controls(data, controls)
    cells = _cells(_prepared(data, categories, numbers, outcome), categories)
    return _sums(cells, controls, categories, numbers, outcome)


def model_moments(
    data: DataFrame, controls: Sequence[str] = (), outcome: str = "is_multifam"
) -> DataFrame:
    """Mergeable moments of the numeric controls and the outcome per year, race and text controls.

    A record per cell, to be stored: ``merge_model_moments`` adds further years or parts of a year, and
    ``fit_moments`` fits from them.
    """
    categories, numbers = _split_controls(data, controls)
    values = [f"z_{k}" for k in range(1, 2 + len(numbers))]
    keys = ["YEAR", RACE, *categories]
    ship_package(data.sparkSession)
    records = moments.gather(_prepared(data, categories, numbers, outcome), keys, values, "w")
    return moments.merge(records, keys, len(values))


def merge_model_moments(one: DataFrame, two: DataFrame) -> DataFrame:
    """Moments of all rows behind two tables of moments of the same model."""
    own = (moments.ROWS, moments.WEIGHT, moments.MEANS, moments.PRODUCTS)
    keys = [c for c in one.columns if c not in own]
    size = one.select(F.size(moments.MEANS)).first()
    return two if size is None else moments.merge(one.unionByName(two), keys, size[0])


def fit_moments(
    stored: DataFrame, controls: Sequence[str] = (), outcome: str = "is_multifam"
) -> DataFrame:
    """As ``run_lpm_by_year``, from stored moments of the same controls and outcome."""
    ship_package(stored.sparkSession)
    categories = [c for c in controls if c in stored.columns]
    numbers = [c for c in controls if c not in categories]
    size = 1 + len(numbers)
    year = Window.partitionBy("YEAR")
    weight = F.col(moments.WEIGHT)
    # The outcome is not centred.
    centres = [F.sum(weight * moments.mean(k)).over(year) / F.sum(weight).over(year) for k in range(len(numbers))]
    cells = stored.withColumns({f"c_{k}": c for k, c in enumerate(centres, 1)})
    off = [F.lit(1.0), *[moments.mean(k - 1) - F.col(f"c_{k}") for k in range(1, size)], moments.mean(size - 1)]
    values = []
    for a in range(1 + size):
        for b in range(a, 1 + size):
            own = moments.product(a - 1, b - 1, size) if a else F.lit(0.0)
            values.append((own + weight * off[a] * off[b]).alias(_moment(a, b)))
    share = F.col(moments.WEIGHT) / F.sum(moments.WEIGHT).over(year)
    parts = [(F.col(f"c_{k}") * share).alias(f"centre_{k}") for k in range(1, size)]
    named = cells.select("YEAR", RACE, *categories, F.col(moments.ROWS).alias("rows"), *values, *parts)
    sums = _sums(named, controls, categories, numbers, outcome, centred=True)
    return sums.groupBy("YEAR").applyInPandas(solve_year, RESULT_SCHEMA)


def _sums(
    cells: DataFrame,
    controls: Sequence[str],
    categories: Sequence[str],
    numbers: Sequence[str],
    outcome: str,
    centred: bool = False,
) -> DataFrame:
    """Products of terms per year from moments of cells; with the centres, of which each cell has a part."""
    year = Window.partitionBy("YEAR")
    cells = cells.withColumn("baseline", F.min(RACE).over(year))
    cells = cells.where("rows > 0")
    # Slots: the race, each control in the given order, the outcome.
    slots: list[tuple[Column, int]] = [(F.concat(F.lit(RACE), F.col(RACE)), 0)]
    for control in controls:
        if control in categories:
            level = F.col(control)
            dummy = F.when(level != F.min(level).over(year), F.concat(F.lit(control), level))
            slots.append((dummy, 0))
        else:
            slots.append((F.lit(control), 1 + numbers.index(control)))
    slots.append((F.lit(outcome), 1 + len(numbers)))

    named = cells.withColumns({f"slot_{s}": name for s, (name, _) in enumerate(slots)})
    pairs = [
        F.struct(
            F.col(f"slot_{s}").alias("i"),
            F.col(f"slot_{t}").alias("j"),
            F.lit(s).alias("slot_i"),
            F.lit(t).alias("slot_j"),
            F.col(_moment(slots[s][1], slots[t][1])).alias("value"),
        )
        for s in range(len(slots))
        for t in range(s, len(slots))
    ]
    rows = F.struct(
        F.lit(ROWS_TERM).alias("i"),
        F.lit(ROWS_TERM).alias("j"),
        F.lit(-1).alias("slot_i"),
        F.lit(-1).alias("slot_j"),
        F.col("rows").cast("double").alias("value"),
    )
    moved = [
        F.struct(
            F.lit(CENTRE_TERM).alias("i"),
            F.lit(name).alias("j"),
            F.lit(-1).alias("slot_i"),
            F.lit(1 + list(controls).index(name)).alias("slot_j"),
            F.col(f"centre_{k}").alias("value"),
        )
        for k, name in enumerate(numbers, 1)
        if centred
    ]
    return (
        named.select("YEAR", "baseline", F.explode(F.array(*pairs, rows, *moved)).alias("pair"))
        .select("YEAR", "baseline", "pair.*")
        .where(F.col("i").isNotNull() & F.col("j").isNotNull())
        .groupBy("YEAR", "baseline", "slot_i", "slot_j", "i", "j")
        .agg(F.sum("value").alias("value"))
    )


def run_lpm_by_year(
    data: DataFrame,
    controls: Sequence[str] = (),
    outcome: str = "is_multifam",
    method: str = "moments",
) -> DataFrame:
    """Weighted least squares of ``outcome`` on all races and ``controls`` per year.

    With ``orthogonal`` years are solved from triangular blocks instead of sums of products: slower, and
    right for controls of which earlier ones leave as little as 1e-9 of their length.
    """
    ship_package(data.sparkSession)
    categories, numbers = _split_controls(data, controls)
    if method == "orthogonal":
        prepared = _prepared(data, categories, numbers, outcome)
        return orthogonal.fit(prepared, RACE, categories, numbers, outcome, controls, RESULT_SCHEMA, two_sided_p)
    if method != "moments":
        raise ValueError(f"no method {method!r}")
    if numbers:
        return fit_moments(model_moments(data, controls, outcome), controls, outcome)
    cells = _cells(_prepared(data, categories, numbers, outcome), categories)
    sums = _sums(cells, controls, categories, numbers, outcome)
    return sums.groupBy("YEAR").applyInPandas(solve_year, RESULT_SCHEMA)


def solve_year(stats: pd.DataFrame) -> pd.DataFrame:
    """Coefficient rows of one year from its centred cross products and the centres."""
    rows = float(stats.loc[stats["i"] == ROWS_TERM, "value"].iloc[0])
    centre_of = stats[stats["i"] == CENTRE_TERM].set_index("slot_j")["value"].to_dict()
    stats = stats[~stats["i"].isin([ROWS_TERM, CENTRE_TERM])]
    ends = [
        stats[["slot_i", "i"]].set_axis(["slot", "term"], axis=1),
        stats[["slot_j", "j"]].set_axis(["slot", "term"], axis=1),
    ]
    ordered = pd.concat(ends).drop_duplicates().sort_values(["slot", "term"])
    place = {key: k for k, key in enumerate(zip(ordered["slot"], ordered["term"]))}
    gram = np.zeros((len(place), len(place)))
    for row in stats.itertuples():
        a, b = place[row.slot_i, row.i], place[row.slot_j, row.j]
        gram[a, b] = gram[b, a] = row.value

    outcome = len(place) - 1
    terms = list(ordered["term"])[:outcome]
    slots = list(ordered["slot"])[:outcome]
    centre = np.array([centre_of.get(slot, 0.0) for slot in slots])
    races = np.array(slots) == 0
    weight = gram[:outcome, :outcome][np.ix_(races, races)].trace()
    lengths = np.diag(gram)[:outcome].copy()
    # A constant control keeps nothing but rounding when it is centred.
    lengths[lengths < _CONSTANT * (lengths + weight * centre**2)] = 0.0
    scale = np.sqrt(lengths)
    scale[scale == 0] = 1.0
    xx = gram[:outcome, :outcome] / np.outer(scale, scale)
    xx[lengths == 0, :] = xx[:, lengths == 0] = 0.0
    xy = gram[:outcome, outcome] / scale
    kept = independent_columns(xx)
    inverse = np.linalg.inv(xx[np.ix_(kept, kept)])
    beta = inverse @ xy[kept]
    residual = gram[outcome, outcome] - 2 * beta @ xy[kept] + beta @ xx[np.ix_(kept, kept)] @ beta
    if residual < _PERFECT * gram[outcome, outcome]:
        residual = 0.0
    freedom = rows - len(kept)

    # Back from centred controls: each race term loses the controls' part at their centres.
    back = np.eye(len(kept))
    back[np.ix_(races[kept], ~races[kept])] -= centre[kept][~races[kept]]
    back = back / scale[kept]
    estimate = np.full(outcome, np.nan)
    error = np.full(outcome, np.nan)
    estimate[kept] = back @ beta
    if freedom > 0:
        error[kept] = np.sqrt(np.diag(back @ inverse @ back.T) * residual / freedom)
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
            "YEAR": int(stats["YEAR"].iloc[0]),
            "baseline": stats["baseline"].dropna().iloc[0],
        }
    )


def independent_columns(xx: np.ndarray) -> list[int]:
    """Columns of a unit-diagonal cross product that add to the earlier ones."""
    left = xx.copy()
    kept = []
    for k in range(len(xx)):
        if left[k, k] > _COLLINEAR:
            kept.append(k)
            left = left - np.outer(left[:, k], left[k, :]) / left[k, k]
    return kept


def two_sided_p(statistic: float, freedom: float) -> float:
    """P(|T| > |statistic|) of Student's t, by the incomplete beta function."""
    if math.isnan(statistic) or freedom <= 0:
        return math.nan
    ratio = statistic * statistic / freedom
    if freedom >= _MANY:
        # Hill's expansion around the normal distribution; its next term is below rounding here.
        a = freedom - 0.5
        w = math.sqrt(a * math.log1p(ratio))
        return math.erfc((w + (w**3 + 3 * w) / (48 * a * a)) / math.sqrt(2))
    return _t_tail(freedom / 2, ratio)


def _log_gamma_step(a: float) -> float:
    """log of gamma(a + 1/2) / gamma(a)."""
    if a < 50:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    # Stirling's series of the ratio; differences of large lgammas would lose digits.
    return (
        0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5) + 17 / (14336 * a**7)
    )


def _t_tail(a: float, ratio: float) -> float:
    """Incomplete beta function at x = 1 / (1 + ratio), with parameters a and 1/2."""
    if ratio <= 0.0:
        return 1.0
    b = 0.5
    x, rest = 1.0 / (1.0 + ratio), ratio / (1.0 + ratio)
    front = math.exp(
        _log_gamma_step(a) - math.lgamma(b) - a * math.log1p(ratio) + b * math.log(rest)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, rest) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for part in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + part * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + part / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"no convergence for a={a}, b={b}, x={x}")


def filter_by_race(results: DataFrame) -> DataFrame:
    """Race terms shown in the figures, without the prefix, with legend order."""
    rank = F.array_position(F.array(*[F.lit(name) for name in SHOWN_RACES]), F.col("term"))
    return (
        results.where(F.col("term").isin(*[f"{RACE}{name}" for name in SHOWN_RACES]))
        .withColumn("term", F.expr(f"substring(term, {len(RACE) + 1})"))
        .withColumn("term_rank", rank.cast("int"))
    )
