"""Stage tables in Parquet and result tables in CSV."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Survey years of the extract.
SAMPLE_YEARS = (
    1960, 1970, 1980, 1990, 2000, 2001, 2002, 2003, 2004, 2005, 2006, 2007, 2008, 2009,
    2010, 2011, 2012, 2013, 2014, 2015, 2016, 2017, 2018, 2019, 2020, 2021, 2022, 2023,
)

# Requested variables, and the keys and weights that always come along.
REQUESTED_VARIABLES = (
    "NUMPREC", "OWNERSHP", "KITCHEN", "ROOMS", "UNITSSTR", "BEDROOMS", "NFAMS", "HHINCOME",
    "RENT", "OWNCOST", "CITY", "PERNUM", "PERWT", "RELATE", "SEX", "AGE", "RACE", "HISPAN",
    "SUBFAM", "EMPSTAT", "INCTOT", "EDUC",
)
PRESELECTED_VARIABLES = ("YEAR", "SERIAL", "HHWT", "GQ")


def select_samples(
    extract: DataFrame,
    years: Sequence[int] = SAMPLE_YEARS,
    variables: Sequence[str] = REQUESTED_VARIABLES,
    allow_missing: bool = False,
) -> DataFrame:
    """The chosen survey years and variables, plus keys and weights.

    On a table partitioned by YEAR other years are never read. Columns are found whatever their
    case and get the variable's own spelling. A variable that the extract lacks is an error,
    or left out with ``allow_missing``.
    """
    own = {name.upper(): name for name in extract.columns}
    wanted = [*PRESELECTED_VARIABLES, *variables]
    missing = [name for name in wanted if name.upper() not in own]
    if missing and not allow_missing:
        raise ValueError(f"the extract has no {', '.join(missing)}")
    columns = [F.col(own[n.upper()]).alias(n) for n in wanted if n.upper() in own]
    return extract.where(F.col(own["YEAR"]).isin(*years)).select(*columns)


def create_or_replace_table(
    data: DataFrame,
    path: str,
    partition_by: str = "YEAR",
    cluster_by: Sequence[str] = (),
    check: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Write a stage table, replacing an earlier one, and return it as read back.

    Rebalancing gathers each year into few files; adaptive execution splits years
    that are too large for one task. Rows are sorted by ``cluster_by`` within a file. The table is
    written aside and ``check`` sees it there; only then does it take the place of the earlier one, so
    a failed job or check leaves that as it was. ``data`` may read from ``path``.
    """
    spark, columns = data.sparkSession, data.columns
    aside = f"{path}.new-{uuid.uuid4().hex}"
    gathered = data.hint("rebalance", partition_by)
    if cluster_by:
        gathered = gathered.sortWithinPartitions(partition_by, *cluster_by)
    gathered.write.partitionBy(partition_by).parquet(aside)
    try:
        if check is not None:
            check(read_table(spark, aside, data.schema).select(*columns))
    except Exception:
        _remove(spark, aside)
        raise
    _swap(spark, aside, path)
    return read_table(spark, path, data.schema).select(*columns)


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _remove(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place(path), True)


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Rename a finished table into place; the earlier one goes after that."""
    files, place = _file_system(spark, path)
    old = f"{path}.old-{uuid.uuid4().hex}"
    if files.exists(place(path)):
        files.rename(place(path), place(old))
    if not files.rename(place(new), place(path)):
        raise OSError(f"could not rename {new} to {path}")
    files.delete(place(old), True)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def _plain_number(column: Column, kind: T.DataType) -> Column:
    """A number as plain decimal digits, as short as the value allows; never with an exponent."""
    text = column.cast("string")
    if not isinstance(kind, T.DoubleType | T.FloatType):
        return text
    exponent = F.coalesce(F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    whole = F.regexp_extract(text, r"^-?([0-9]+)", 1)
    # A fraction of zero alone is a whole number.
    part = F.regexp_replace(F.regexp_extract(text, r"\.([0-9]+)", 1), "^0$", "")
    digits = F.concat(whole, part)
    point = F.length(whole) + exponent
    moved = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= F.length(digits), F.rpad(digits, point, "0"))
        .otherwise(
            F.concat(
                F.substring(digits, F.lit(1), point),
                F.lit("."),
                F.substring(digits, point + 1, F.length(digits)),
            )
        )
    )
    finite = text.rlike("^-?[0-9]")
    return F.when(~finite, F.lit("NA")).otherwise(F.concat(sign, moved))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(table: DataFrame, quote: bool = False) -> DataFrame:
    """One text column: each row as a CSV line with TRUE, FALSE and NA.

    Text is quoted always with ``quote``, otherwise only where it holds a comma, a quote or a
    line break.
    """
    cells = []
    for field in table.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.BooleanType):
            text = F.upper(column.cast("string"))
        elif isinstance(field.dataType, T.NumericType):
            text = _plain_number(column, field.dataType)
        else:
            plain = column.cast("string")
            text = _quoted(plain)
            if not quote:
                text = F.when(plain.rlike('[,"\r\n]'), text).otherwise(plain)
        cells.append(F.coalesce(text, F.lit("NA")))
    return table.select(F.concat_ws(",", *cells).alias("value"))


def csv_header(table: DataFrame, quote: bool = False) -> str:
    names = [name.replace('"', '""') for name in table.columns]
    return ",".join(
        f'"{name}"' if quote or any(c in name for c in ',"\r\n') else name for name in names
    )


def write_result_csv(
    table: DataFrame, path: str, order_by: Sequence[str], quote_header: bool = False
) -> None:
    """Write a final table as one CSV file with TRUE, FALSE and NA and plain decimals.

    For published tables only: a row per combination of category codes. With
    ``quote_header`` text and the header are quoted. Rows stand in the order of ``order_by``.
    """
    ordered = table.repartition(1).sortWithinPartitions(*order_by)
    lines = csv_lines(ordered, quote_header)
    header = table.sparkSession.createDataFrame([(csv_header(table, quote_header),)], "value string")
    # One partition each, and one file: the header's partition comes first.
    header.repartition(1).union(lines).coalesce(1).write.mode("overwrite").text(path)
