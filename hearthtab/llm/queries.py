"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthtab.llm import alignment, conversation_trie, decontaminate, extract, language_id, packing, pii, quality, secrets, sharding, simhash, substrings, toxicity
from hearthtab.llm.common import id_crc32
from hearthtab.llm.oracle import quality_sql, secrets_sql, trie_sql
from hearthtab.sources.shipping import ship_package

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_text(_table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_id.held_out(id_crc32(F.col("doc_id")))
    model = language_id.fit(docs.where(~out))
    return language_id.predict(docs, model).select(
        "doc_id", out.alias("held_out"), "lang_pred", "score"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(
        _table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE_RULES]
    counts = [_count_of("spans", kind).alias(f"n_{kind}") for kind in base]
    found = F.filter("spans", lambda s: s["kind"].isin(base))
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(secrets.span_text(found).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(_table(spark, sf_dir, "documents"))
    # Distances to nine digits, as sums of floating point numbers depend on their order.
    return judged.withColumns(
        {c: F.round(c, 9) for c in ("class_distance", "word_distance")}
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = pii.find_personal_data(docs, pii.fit(docs)).withColumn("_base", pii.base_only(F.col("spans")))
    return rows.select(
        "doc_id",
        *[_count_of("_base", kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(secrets.span_text(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def _toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel | None:
    return toxicity.fit(docs, labels.where(id_crc32(F.col("doc_id")) % 5 != 0))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = _toxicity_model(docs, _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(id_crc32(F.col("doc_id")) % 5 == 0, F.lit(False))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted"
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(
        _table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    ).drop("groups")


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_secrets": op4_secrets,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_decontaminate": op7_decontaminate,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_sharding": op10_sharding,
    "op11_substrings": op11_substrings,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_alignment": op13_alignment,
}
# The others need checksums, hashes, models or tokenizers that SQL lacks; tests check them by brute force.
LLM_ORACLES: dict[str, str] = {"op4_secrets": secrets_sql(), "op6_quality": quality_sql(), "op12_prefix_trie": trie_sql()}
