"""Fixed-width person records described by an XML codebook."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A column of the record: 1-based start, width and implied decimals."""

    name: str
    start: int
    width: int
    decimals: int = 0
    numeric: bool = True

    @property
    def type(self) -> str:
        if not self.numeric:
            return "string"
        if self.decimals:
            return f"decimal({max(self.width, self.decimals)},{self.decimals})"
        return "int" if self.width <= 9 else "bigint"


def read_codebook(spark: SparkSession, path: str) -> list[Field]:
    """Record layout from a codebook, a small file on any file system Spark reads."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return parse_codebook(text)


def parse_codebook(text: str) -> list[Field]:
    fields = []
    for var in ElementTree.fromstring(text).iter():
        if _local_name(var) != "var":
            continue
        parts = {_local_name(child): child for child in var}
        location = parts["location"]
        kind = parts["varFormat"].get("type", "numeric") if "varFormat" in parts else "numeric"
        start = int(location.get("StartPos"))
        width = location.get("width") or int(location.get("EndPos")) - start + 1
        fields.append(
            Field(
                var.get("name") or var.get("ID"),
                start,
                int(width),
                int(var.get("dcml") or 0),
                kind == "numeric",
            )
        )
    return fields


def _local_name(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _parse(field: Field) -> Column:
    text = F.nullif(F.trim(F.substring("value", field.start, field.width)), F.lit(""))
    if field.numeric and field.decimals:
        digits = text.cast(f"decimal({field.width},0)")
        return (digits * F.lit(Decimal(1).scaleb(-field.decimals))).cast(field.type)
    return text.cast(field.type)


# File endings of compressed text that one task must read from start to end.
_UNSPLITTABLE = (".gz", ".deflate", ".snappy", ".xz")
_TASKS_PER_CORE = 3


def read_fixed_width(
    spark: SparkSession,
    path: str,
    codebook: Sequence[Field],
    columns: Sequence[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Typed columns of fixed-width text; blanks are NULL, a bad number is an error.

    A gzip file cannot be split: one task reads its lines, which are then spread over
    ``partitions`` tasks before they are parsed (by default a few per core). Files that can be
    split stay as they are unless ``partitions`` is given. Convert the text to a partitioned table
    once rather than querying it.
    """
    fields = [f for f in codebook if columns is None or f.name in columns]
    missing = set(columns or ()) - {f.name for f in fields}
    if missing:
        raise ValueError(f"the codebook has no {', '.join(sorted(missing))}")
    lines = spark.read.text(path)
    if partitions is None and any(f.endswith(_UNSPLITTABLE) for f in lines.inputFiles()):
        partitions = _TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    if partitions is not None:
        lines = lines.repartition(partitions)
    return lines.select(*[_parse(f).alias(f.name) for f in fields])


def codebook_text(codebook: Sequence[Field]) -> str:
    """The codebook of a record layout as XML."""
    root = ElementTree.Element("codeBook")
    data = ElementTree.SubElement(root, "dataDscr")
    for field in codebook:
        var = ElementTree.SubElement(
            data, "var", ID=field.name, name=field.name, dcml=str(field.decimals)
        )
        ElementTree.SubElement(
            var,
            "location",
            StartPos=str(field.start),
            EndPos=str(field.start + field.width - 1),
            width=str(field.width),
        )
        kind = "numeric" if field.numeric else "character"
        ElementTree.SubElement(var, "varFormat", type=kind)
    return ElementTree.tostring(root, encoding="unicode")


def write_codebook(spark: SparkSession, path: str, codebook: Sequence[Field]) -> None:
    """Write the codebook as one small text file in a folder of its own."""
    text = spark.createDataFrame([(codebook_text(codebook),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(path)


def write_fixed_width(data: DataFrame, path: str, codebook: Sequence[Field]) -> None:
    """Write rows as gzip fixed-width text; a value that does not fit is an error."""

    def cell(field: Field) -> Column:
        value = F.col(field.name)
        if field.decimals:
            value = (value.cast(field.type) * 10**field.decimals).cast("bigint")
        text = F.coalesce(value.cast("string"), F.lit(""))
        fits = F.length(text) <= field.width
        too_wide = F.raise_error(F.concat(F.lit(f"{field.name} too wide: "), text))
        return F.lpad(F.when(fits, text).otherwise(too_wide.cast("string")), field.width, " ")

    ordered = sorted(codebook, key=lambda f: f.start)
    line = F.concat(*[cell(f) for f in ordered])
    data.select(line.alias("value")).write.mode("overwrite").option("compression", "gzip").text(
        path
    )
