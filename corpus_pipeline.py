"""Corpus pipeline: toxicity, near-duplicates, decontamination, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthtab.llm import decontaminate, packing, secrets, simhash, toxicity
from hearthtab.llm.common import id_crc32, staged
from hearthtab.sources.shipping import ship_package

TOKENIZER = "word_bpe_49k.json"


class _Aside:
    """Documents under positional column names, so that columns of any name may come along."""

    def __init__(self, docs: DataFrame) -> None:
        self._names = docs.columns
        self.rows = docs.toDF(*[f"_c{k}" for k in range(len(self._names))])

    def __getitem__(self, name: str) -> Column:
        return F.col(f"_c{self._names.index(name)}")

    def back(self, rows: DataFrame, **changed: Column) -> DataFrame:
        """The columns of the documents, some of them changed, under their own names."""
        return rows.select(
            *[changed.get(n, F.col(f"_c{k}")).alias(f"_c{k}") for k, n in enumerate(self._names)]
        ).toDF(*self._names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(id_crc32(F.col("doc_id")) % 5 != 0))
    score = toxicity.toxicity_score(spark, model)
    held = _Aside(docs)
    return held.back(held.rows.where(score(held["text"]) < 0.5))


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest identifier.

    Rows are told apart by identifier and text; of rows equal in both, one stays. A null identifier
    counts as the smallest.
    """
    held = _Aside(docs)
    marked = held.rows.withColumn(
        "_row", F.struct(held["doc_id"].alias("doc_id"), F.xxhash64(held["text"]).alias("content"))
    )
    groups = simhash.near_duplicates(marked.select("_row", held["text"].alias("text")), id_column="_row")
    first = groups.where("_row = component").groupBy("_row").agg(F.count(F.lit(1)).alias("_copies"))
    first = first.select(
        F.col("_row.doc_id").alias("_first"), F.col("_row.content").alias("_content"), "_copies"
    )
    chosen = marked.join(
        first, held["doc_id"].eqNullSafe(F.col("_first")) & (F.col("_row.content") == F.col("_content"))
    )
    once = chosen.where("_copies = 1")
    repeated = chosen.where("_copies > 1").dropDuplicates(["_first", "_content"])
    return held.back(once.unionByName(repeated))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    held = _Aside(docs)
    rows = held.rows
    for leak in decontaminate.has_leak(spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        rows = rows.where(~leak(held["text"]))
    return held.back(rows)


def _masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``[kind]``; of overlapping spans the first is named."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, span: Column) -> Column:
        # What lies between the last span's end and this one, and the kind if it is not inside it.
        gap = F.greatest(span["start"] - state["at"], F.lit(0))
        return F.struct(
            F.concat(
                state["done"],
                F.substring(text, (state["at"] + 1).cast("int"), gap.cast("int")),
                F.when(
                    span["start"] >= state["at"], F.concat(F.lit("["), span["kind"], F.lit("]"))
                ).otherwise(F.lit("")),
            ).alias("done"),
            F.greatest(state["at"], span["end"]).alias("at"),
        )

    return F.aggregate(
        spans,
        start,
        step,
        lambda s: F.concat(
            s["done"],
            F.substring(text, (s["at"] + 1).cast("int"), F.char_length(text)),
        ),
    )


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by their kind."""
    found = secrets.scan_secrets(docs).where(F.size("spans") > 0)
    # One row per blob: texts of equal content share their spans.
    by_blob = staged(found.select("blob", "spans").dropDuplicates(["blob"]), "secret_spans")
    held = _Aside(docs)
    text = held["text"]
    joined = held.rows.withColumn("_blob", secrets.blob_of(text)).join(
        by_blob.toDF("_blob", "_spans"), "_blob", "left"
    )
    masked = joined.withColumn(
        "_masked", F.when(F.col("_spans").isNotNull(), _masked(text, F.col("_spans"))).otherwise(text)
    )
    length = F.when(F.col("_spans").isNotNull(), F.char_length("_masked").cast("long"))
    changed = {"text": F.col("_masked")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(length, held["n_chars"])
    return held.back(masked, **changed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in training sequences."""
    pieces = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_group),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack),
]

# A classifier and a tokenizer are part of it, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
