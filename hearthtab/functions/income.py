"""Income in 2023 dollars with one bottom and one top code for all years."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING_INCOME = 9999999
BOTTOM_INCOME = -19998
TOP_INCOME = 250000
INCOME_TYPE = "decimal(16,3)"

# Year, nominal bottom code, nominal top code, factor to 2023 dollars.
INCOME_PARAMETERS = (
    (1960, -1911, 23886, "10.466"),
    (1970, -2409, 30121, "8.300"),
    (1980, -4766, 59586, "4.196"),
    (1990, -8139, 101749, "2.457"),
    (2000, -11312, 141417, "1.768"),
    (2001, -11625, 145324, "1.720"),
    (2002, -11813, 147678, "1.693"),
    (2003, -12087, 151105, "1.654"),
    (2004, -12402, 155045, "1.612"),
    (2005, -12824, 160317, "1.559"),
    (2006, -13243, 165557, "1.510"),
    (2007, -13606, 170087, "1.470"),
    (2008, -14133, 176680, "1.415"),
    (2009, -14078, 175997, "1.420"),
    (2010, -14318, 178992, "1.397"),
    (2011, -14762, 184548, "1.355"),
    (2012, -15067, 188361, "1.327"),
    (2013, -15299, 191259, "1.307"),
    (2014, -15538, 194247, "1.287"),
    (2015, -15560, 194523, "1.285"),
    (2016, -15762, 197046, "1.269"),
    (2017, -16110, 201399, "1.241"),
    (2018, -16499, 206259, "1.212"),
    (2019, -16777, 209739, "1.192"),
    (2020, -16986, 212345, "1.177"),
    (2021, -17787, 222358, "1.124"),
    (2022, -19225, 240334, "1.040"),
    (2023, -19998, 250000, "1.000"),
)


def income_parameters(spark: SparkSession) -> DataFrame:
    """The parameter table: one row per survey year."""
    rows = ", ".join(
        f"({year}, {bottom}, {top}, CAST({Decimal(factor)} AS DECIMAL(6,3)))"
        for year, bottom, top, factor in INCOME_PARAMETERS
    )
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS t(YEAR, income_bottom, income_top, income_factor)"
    )


def harmonized_income(inctot: Column, bottom: Column, top: Column, factor: Column) -> Column:
    """Exact decimal income; NULL if missing or if the year has no parameters."""
    scaled = (inctot.cast("decimal(9,0)") * factor).cast(INCOME_TYPE)
    return (
        F.when(inctot == MISSING_INCOME, F.lit(None).cast(INCOME_TYPE))
        .when(inctot <= bottom, F.lit(BOTTOM_INCOME).cast(INCOME_TYPE))
        .when(inctot >= top, F.lit(TOP_INCOME).cast(INCOME_TYPE))
        .otherwise(scaled)
    )


def add_harmonized_income(df: DataFrame, parameters: DataFrame | None = None) -> DataFrame:
    """Add ``inctot_harmonized``.

    The built-in parameters have one row per survey year and are broadcast. A table given
    by the caller is joined as Spark sees fit, after a check that no year is repeated.
    """
    if parameters is None:
        parameters = F.broadcast(income_parameters(df.sparkSession))
    else:
        repeated = parameters.groupBy("YEAR").agg(F.count("*").alias("n")).where("n > 1")
        if not repeated.isEmpty():
            raise ValueError("the income parameters have a repeated year")
    columns = df.columns
    joined = df.join(parameters, "YEAR", "left")
    income = harmonized_income(
        F.col("INCTOT"), F.col("income_bottom"), F.col("income_top"), F.col("income_factor")
    )
    return joined.select(*columns, income.alias("inctot_harmonized"))
