"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthtab.sources.workspace import new_location


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Columns by exact name under new names: ``pick(df, id="doc_id")``.

    Works by position, so extra columns may differ from these only in case, or bear
    any name an operator uses inside.
    """
    places = [f"_c{k}" for k in range(len(df.columns))]
    moved = df.toDF(*places)
    return moved.select(
        *[moved[places[df.columns.index(old)]].alias(new) for new, old in names.items()]
    )


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back.

    Cuts the lineage: later jobs, and tasks repeated after an executor is lost,
    read the same rows instead of computing them again.
    """
    spark = df.sparkSession
    path = new_location(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """As :func:`staged`, laid out by keys: joins on them need not move these rows again.

    A table of the session's catalog, with its files in the shared folder.
    """
    spark = df.sparkSession
    path = new_location(spark, name)
    table = "hearthtab_" + path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    df.write.bucketBy(buckets, *keys).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def id_crc32(column: Column) -> Column:
    """CRC-32 of the identifier as text."""
    return F.crc32(column.cast("string").cast("binary"))
