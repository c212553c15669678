"""Census-shaped persons from order lines: a line is a person, an order a household."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthtab.operators.household import HOUSEHOLD_KEY
from hearthtab.operators.skew import (
    DEFAULT_LIMITS,
    HeavyKeys,
    SkewLimits,
    find_heavy,
    number_rows,
    salted_join,
)
from hearthtab.sources.fixed_width import Field

_LINE_ORDER = (
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_shipdate",
)

# The year follows from the order number, so both tables can be laid out by household.
_YEAR = (
    "CAST(CASE WHEN SERIAL % 28 < 4 THEN 1960 + 10 * (SERIAL % 28) ELSE 1996 + SERIAL % 28 END "
    "AS INT) AS YEAR"
)

# Column, type, Spark SQL expression.
_HOUSEHOLD_COLUMNS = (
    ("HHWT", "double", "1 + o_custkey % 100"),
    (
        "GQ",
        "int",
        "CASE WHEN o_custkey % 10 < 6 THEN 1 WHEN o_custkey % 10 < 8 THEN 2 "
        "WHEN o_custkey % 10 = 8 THEN 3 ELSE 4 END",
    ),
    ("NFAMS", "int", "o_custkey % 7"),
    ("ROOMS", "int", "1 + o_custkey % 12"),
    ("BEDROOMS", "int", "o_custkey % 8"),
    ("OWNERSHP", "int", "CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 2 END"),
    ("RENT", "int", "CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 100 + (SERIAL * 37) % 4400 END"),
    ("CITY", "int", "CASE WHEN o_custkey % 4 = 0 THEN 5350 ELSE 0 END"),
)
_PERSON_COLUMNS = (
    ("PERWT", "double", "l_quantity"),
    ("AGE", "int", "l_partkey % 95"),
    ("SEX", "int", "1 + l_suppkey % 2"),
    ("RACE", "int", "1 + l_suppkey % 9"),
    (
        "HISPAN",
        "int",
        "CASE WHEN l_partkey % 20 = 19 THEN 9 WHEN l_partkey % 5 = 0 THEN 1 + l_suppkey % 4 "
        "ELSE 0 END",
    ),
    ("RELATE", "int", "CASE WHEN PERNUM = 1 THEN 1 ELSE 2 + (l_partkey + l_linenumber) % 11 END"),
    ("EDUC", "int", "l_partkey % 12"),
    (
        "INCTOT",
        "int",
        "CASE WHEN l_partkey % 95 < 15 THEN 9999999 "
        "WHEN l_suppkey % 4 = 0 THEN floor(l_extendedprice) * 3 - 25000 "
        "WHEN l_suppkey % 4 = 1 THEN -3 * floor(l_extendedprice / 10) "
        "ELSE floor(l_extendedprice / 10) END",
    ),
)

PERSON_COLUMNS = (
    "YEAR", "SERIAL", "PERNUM", "NUMPREC", "PERWT", "HHWT", "GQ", "AGE", "SEX", "RACE",
    "HISPAN", "RELATE", "NFAMS", "ROOMS", "BEDROOMS", "OWNERSHP", "RENT", "CITY", "EDUC",
    "INCTOT",
)


# The record layout used when persons are written as fixed-width text.
RECORD_LAYOUT = (
    Field("YEAR", 1, 4),
    Field("SERIAL", 5, 12),
    Field("PERNUM", 17, 9),
    Field("NUMPREC", 26, 9),
    Field("PERWT", 35, 10, decimals=2),
    Field("HHWT", 45, 10, decimals=2),
    Field("GQ", 55, 1),
    Field("AGE", 56, 3),
    Field("SEX", 59, 1),
    Field("RACE", 60, 1),
    Field("HISPAN", 61, 1),
    Field("RELATE", 62, 2),
    Field("NFAMS", 64, 2),
    Field("ROOMS", 66, 2),
    Field("BEDROOMS", 68, 2),
    Field("OWNERSHP", 70, 1),
    Field("RENT", 71, 5),
    Field("CITY", 76, 4),
    Field("EDUC", 80, 2),
    Field("INCTOT", 82, 7),
)

_COLUMNS = {
    name: f"CAST({text} AS {kind}) AS {name}"
    for name, kind, text in (
        ("YEAR", "int", "YEAR"),
        ("SERIAL", "bigint", "SERIAL"),
        ("PERNUM", "int", "PERNUM"),
        ("NUMPREC", "int", "NUMPREC"),
        *_HOUSEHOLD_COLUMNS,
        *_PERSON_COLUMNS,
    )
}


def _lines(spark: SparkSession, sf_dir: str, hot: bool = False) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if hot:
        return lines.withColumn("SERIAL", F.expr(_hot("l_orderkey")))
    return lines.withColumnRenamed("l_orderkey", "SERIAL")


def _orders(spark: SparkSession, sf_dir: str, hot: bool = False) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    if hot:
        # The customer of the hot household is the smallest of its orders' customers.
        joined = orders.selectExpr(f"{_hot('o_orderkey')} AS SERIAL", "o_custkey")
        return joined.groupBy("SERIAL").agg(F.min("o_custkey").alias("o_custkey"))
    return orders.selectExpr("o_orderkey AS SERIAL", "o_custkey")


# Orders whose customer is in this part of all form one household in the hot view.
HOT_SERIAL = 28 * 10_000_000 + 7
HOT_LIMITS = SkewLimits(rows_per_task=1000)


def _hot(serial: str) -> str:
    """SQL: every third order becomes the hot household."""
    return f"CASE WHEN {serial} % 3 = 0 THEN {HOT_SERIAL}L ELSE {serial} END"


_HEAVY: dict[tuple, HeavyKeys] = {}


def heavy_households(
    spark: SparkSession, sf_dir: str, limits: SkewLimits = DEFAULT_LIMITS, hot: bool = False
) -> HeavyKeys:
    """Households too large for one task, looked up once per session and table."""
    key = (spark.sparkContext.applicationId, sf_dir, limits, hot)
    if key not in _HEAVY:
        lines = _lines(spark, sf_dir, hot).selectExpr(_YEAR, "SERIAL")
        _HEAVY[key] = find_heavy(lines, HOUSEHOLD_KEY, limits)
    return _HEAVY[key]


def person(
    spark: SparkSession,
    sf_dir: str,
    columns: Sequence[str] = PERSON_COLUMNS,
    heavy: HeavyKeys | None = None,
    hot: bool = False,
) -> DataFrame:
    """The person table; ``hot`` puts a third of all orders into one household.

    Name the ``columns`` needed: without PERNUM, RELATE and NUMPREC, which depend
    on the whole household, it is one join of a few columns.
    """
    lines, orders = _lines(spark, sf_dir, hot), _orders(spark, sf_dir, hot)
    if not {"PERNUM", "RELATE", "NUMPREC"} & set(columns):
        # Both sides are read straight from their tables, so adaptive execution can
        # split a household that is too large.
        joined = lines.join(orders, "SERIAL").selectExpr("*", _YEAR)
        return joined.selectExpr(*[_COLUMNS[name] for name in columns])

    if heavy is None:
        heavy = heavy_households(spark, sf_dir, hot=hot)
    # A row's place in its file is needed only to cut heavy households apart.
    row_id = () if heavy.table is None else ("file_path", "row_index")
    numbered = number_rows(
        lines.selectExpr(
            _YEAR, "SERIAL", *_LINE_ORDER, *[f"_metadata.{name} AS {name}" for name in row_id]
        ),
        keys=HOUSEHOLD_KEY,
        order=_LINE_ORDER,
        row_id=row_id,
        number_col="PERNUM",
        size_col="NUMPREC",
        heavy=heavy,
    )
    attributes = orders.selectExpr("*", _YEAR)
    joined = salted_join(numbered, attributes, HOUSEHOLD_KEY, ["PERNUM"], heavy, "inner")
    return joined.selectExpr(*[_COLUMNS[name] for name in columns])
