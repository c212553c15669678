"""Secret scan over an incremental blob ledger.

Every version of a path is addressed by the SHA-256 of its text (its blob). The ledger lists
which rule versions have been run on which blob, and what they found. A scan runs only
the pairs of blob and rule version that the ledger lacks, on one copy of each blob, and joins
findings back to all paths with that blob. Only DataFrame expressions are used.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthtab.llm.common import pick, staged
from hearthtab.sources.workspace import new_location


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java pattern; the value in ``group`` has ``least`` characters or more.

    ``hint`` is a pattern that every text with such a match has; it is cheaper to look for.
    """

    kind: str
    pattern: str
    group: int
    least: int
    hint: str

    @property
    def version(self) -> str:
        text = "\0".join((self.kind, self.pattern, str(self.group), str(self.least)))
        return f"{self.kind}-{hashlib.sha256(text.encode()).hexdigest()[:12]}"


# The kinds every scan must find, in their order.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        12,
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14}"),
    Rule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16}"),
)
# Kinds added to them: public token formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, r"gh[pousr]_[A-Za-z0-9]{36}"),
)
RULES = BASE_RULES + MORE_RULES

LEDGER_SCHEMA = (
    "blob binary, versions array<string>, "
    "findings array<struct<start: long, rank: int, end: long, kind: string, version: string>>"
)


def blob_of(text: Column) -> Column:
    """Address of a text; a null text is the empty blob."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at a path; empty if there is none yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def _matches(rule: Rule) -> Column:
    """Of each match in ``_text``: the characters before it since the last one, its own, its value's."""
    text = F.col("_text")
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern)
    lengths = F.transform(
        F.arrays_zip(found.alias("m"), value.alias("v"), gaps.alias("g")),
        lambda x, k: F.struct(
            F.lit(rule.version).alias("version"),
            k.alias("k"),
            # One more gap than matches: the last one has no match.
            F.char_length(x["g"]).cast("long").alias("gap"),
            F.char_length(x["m"]).cast("long").alias("size"),
            (F.char_length(x["v"]) >= rule.least).alias("kept"),
        ),
    )
    wanted = F.array_contains("_todo", rule.version) & text.rlike(rule.hint)
    return F.when(wanted, F.filter(lengths, lambda x: x["size"].isNotNull())).otherwise(F.array())


def _find(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of the rules in ``_todo``: one row per blob that has any.

    Matches are numbered along the text and their places summed up in a window per
    blob and rule, so that a text with many matches costs no more per match.
    """
    matches = blobs.select("blob", F.explode(F.concat(*[_matches(r) for r in rules])).alias("x")).select(
        "blob", "x.*"
    )
    along = Window.partitionBy("blob", "version").orderBy("k")
    ends = matches.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along)).where("kept")
    ranks = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.version, k)])
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.version, r.kind)])
    finding = F.struct(
        (F.col("end") - F.col("size")).alias("start"),
        ranks[F.col("version")].alias("rank"),
        F.col("end"),
        kinds[F.col("version")].alias("kind"),
        F.col("version"),
    )
    return ends.groupBy("blob").agg(F.collect_set(finding).alias("findings"))


def update_ledger(
    versions: DataFrame,
    ledger_path: str,
    rules: tuple[Rule, ...] = RULES,
    id_column="doc_id",
    text_column="text",
) -> DataFrame:
    """Run all missing pairs of blob and rule version, add them to the ledger, and return it.

    One row per blob and update is appended; rows are only ever added, and a failed update adds none.
    """
    spark = versions.sparkSession
    rows = pick(versions, _id=id_column, _text=text_column).select(
        # Null identifiers take part as a path of their own.
        F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_path"),
        blob_of(F.col("_text")).alias("blob"),
        F.coalesce("_text", F.lit("")).alias("_text"),
    )
    current = F.array(*[F.lit(r.version) for r in rules])
    seen = (
        read_ledger(spark, ledger_path)
        .select("blob", F.explode("versions").alias("version"))
        .groupBy("blob")
        .agg(F.collect_set("version").alias("seen"))
    )
    # One path stands for all that have the same blob; texts are not moved for this.
    todo = (
        rows.groupBy("blob")
        .agg(F.min("_path").alias("_path"))
        .join(seen, "blob", "left")
        .withColumn("_todo", F.array_except(current, F.coalesce("seen", F.array().cast("array<string>"))))
        .where(F.size("_todo") > 0)
        .select("blob", "_path", "_todo")
    )
    # Rows repeated with the same path and text are one; they are combined before the shuffle of the join.
    once = rows.groupBy("blob", "_path").agg(F.first("_text").alias("_text"))
    chosen = once.join(todo.hint("shuffle_hash"), ["blob", "_path"]).select("blob", "_text", "_todo")
    found = _find(chosen, rules)
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,version:string>>")
    (
        todo.select("blob", F.col("_todo").alias("versions"))
        .join(found, "blob", "left")
        .select("blob", "versions", F.coalesce("findings", none).alias("findings"))
        .write.mode("append")
        .parquet(ledger_path)
    )
    return read_ledger(spark, ledger_path)


def scan_secrets(
    versions: DataFrame,
    ledger_path: str | None = None,
    rules: tuple[Rule, ...] = RULES,
    id_column="doc_id",
    text_column="text",
) -> DataFrame:
    """Spans of secrets of every row: the identifier, ``blob``, ``spans``.

    ``spans`` is an array of (start, rank, end, kind, version) by start and rank of the rule;
    places are code points, the end exclusive. Empty for a null or empty text. Every row
    gets the findings of its blob, also repeated rows and null identifiers. Without a ledger path
    a new ledger is used. Extra columns are not read; an empty table gives an empty result.
    """
    path = ledger_path or new_location(versions.sparkSession, "ledger")
    ledger = update_ledger(versions, path, rules, id_column, text_column)
    findings = (
        ledger.select("blob", F.explode("findings").alias("x"))
        .where(F.col("x.version").isin([r.version for r in rules]))
        .groupBy("blob")
        .agg(F.sort_array(F.collect_set("x")).alias("spans"))
    )
    # A stored table, so that adaptive execution can split a blob with very many paths in the join.
    findings = staged(findings, "findings")
    paths = pick(versions, _id=id_column, _text=text_column).select(
        "_id", blob_of(F.col("_text")).alias("blob")
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,version:string>>")
    return paths.join(findings, "blob", "left").select(
        F.col("_id").alias(id_column), "blob", F.coalesce("spans", none).alias("spans")
    )


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
