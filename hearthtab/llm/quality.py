"""Quality rules: counts, and divergence of a document from its language.

The histograms of character classes and of common words of a document are compared with those
of its language (sums over all documents that pass the counts) by the Jensen-Shannon
distance. Common words are too small a part of any text for a fixed limit to be reached: their limit
is a part of the distance that a document without any of them has from its language. Short documents
are guarded: their histograms are too coarse to judge.
Only DataFrame expressions are used; words stay in arrays of their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthtab.llm.common import pick, staged

# Fixed values of the counts.
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
REPEAT_WINDOW = 8
WHITE_SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"

# Character classes besides symbols and white space; what is left is the last class.
CLASSES = (
    ("digit", r"[0-9]+"),
    ("upper", r"[A-Z]+"),
    ("beyond_ascii", r"[^\x00-\x7F]+"),
    ("mark", r"[!-/:-@\[-`{-~&&[^#*$%&|<>]]+"),
)
# Frequent words by language; all others share one bin.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "on", "are", "this"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "nicht", "auf", "ein"),
    "fr": ("de", "la", "le", "et", "les", "des", "un", "une", "est", "que", "pour", "dans"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"),
}
_COMMON = 12
# Guards and limits of the distances (0 to 1).
GUARD_CHARS = 400
GUARD_WORDS = 80
MOST_CLASS_DISTANCE = 0.30
# Part of the distance of a document without common words.
MOST_WORD_PART = 0.95


def repeated_words(words: str) -> str:
    """SQL: words lying in windows of ``REPEAT_WINDOW`` words found twice or more in an array column.

    Needs columns ``_windows`` (a hash per window) and ``_sorted`` from :func:`features`.
    """
    same = "(k > 0 AND _sorted[k].h = _sorted[k - 1].h) OR (k + 1 < size(_sorted) AND _sorted[k].h = _sorted[k + 1].h)"
    return f"sort_array(transform(filter(sequence(0, size(_sorted) - 1), k -> {same}), k -> _sorted[k].i))"


def features(docs: DataFrame, id_column="doc_id", text_column="text", lang_column="lang") -> DataFrame:
    """Counts and histograms of every row, in one pass over the texts."""
    last = REPEAT_WINDOW
    lists = F.create_map(
        *[x for lang, words in COMMON_WORDS.items() for x in (F.lit(lang), F.array(*map(F.lit, words)))]
    )
    rows = (
        pick(docs, _id=id_column, _text=text_column, _lang=lang_column)
        .select("_id", "_lang", F.coalesce("_text", F.lit("")).alias("_text"))
        .withColumn("_words", F.array_remove(F.split("_text", WHITE_SPACE), ""))
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("_common", F.coalesce(lists[F.col("_lang")], F.array().cast("array<string>")))
    )
    size = F.char_length("_text")

    def count(pattern: str) -> Column:
        return (size - F.char_length(F.regexp_replace("_text", pattern, ""))).cast("long")

    counted = rows.select(
        "_id",
        "_lang",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        size.cast("long").alias("n_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        *[count(pattern).alias(f"_{name}") for name, pattern in CLASSES],
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
        F.filter("_words", lambda w: F.array_contains("_common", w)).alias("_hits"),
        "_common",
    )
    # Windows as hashes of hashes; two refer to one array, so that it is made once.
    windows = counted.withColumn(
        "_windows",
        F.expr(
            f"CASE WHEN size(_hashes) >= {last} THEN "
            f"transform(sequence(1, size(_hashes) - {last - 1}), i -> xxhash64(slice(_hashes, i, {last}))) "
            "ELSE array() END"
        ),
    )
    doubtful = windows.withColumn(
        "_sorted",
        F.expr(
            "CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN "
            "sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i))) END"
        ),
    )
    repeats = doubtful.withColumn(
        "_repeats", F.expr(f"CASE WHEN _sorted IS NOT NULL THEN {repeated_words('_sorted')} END")
    )
    covered = (
        "CASE WHEN _repeats IS NOT NULL THEN aggregate(sequence(1, size(_repeats) - 1), 0L, "
        f"(a, k) -> a + least({last}L, _repeats[k] - _repeats[k - 1])) + {last}L ELSE 0L END"
    )
    # size - 1 is at least 1: a repeated window has two places.
    others = F.col("n_chars") - F.col("word_chars")
    rest = F.col("word_chars") - F.col("n_symbols") - sum(
        (F.col(f"_{name}") for name, _ in CLASSES), F.lit(0)
    )
    words = [
        F.when(
            F.size("_common") > k,
            F.size("_hits") - F.size(F.array_remove("_hits", F.get("_common", F.lit(k)))),
        ).otherwise(0)
        for k in range(_COMMON)
    ]
    return repeats.select(
        "_id",
        F.coalesce("_lang", F.lit("")).alias("_lang"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.expr(covered).alias("n_repeat_words"),
        "n_chars",
        F.array(others, F.col("n_symbols"), *[F.col(f"_{n}") for n, _ in CLASSES], rest)
        .cast("array<double>")
        .alias("_classes"),
        F.array(*words, F.col("n_words") - F.size("_hits")).cast("array<double>").alias("_usage"),
    )


def _share(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.transform(values, lambda x: x / F.greatest(total, F.lit(1.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    both = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judge_quality(
    docs: DataFrame, id_column="doc_id", text_column="text", lang_column="lang"
) -> DataFrame:
    """Counts, distances and the verdict of every row.

    Columns: the identifier, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    class_distance, word_distance, base_failed, kept. A null or empty text has no words and fails
    the counts. A distance is null where a guard holds or the language has no
    reference; a null distance never rejects. Nor does the distance of common words where the language's
documents have none. Rows without a language are compared
    with each other's sum by character classes alone. Rows with equal identifiers stay rows of
    their own; an empty table gives an empty result.
    """
    base_failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    # Written, so that the texts are read once for the sums and the verdicts.
    rows = staged(
        features(docs, id_column, text_column, lang_column).withColumn("base_failed", base_failed),
        "quality",
    )
    sums = lambda name, size: F.array(*[F.sum(F.col(name)[k]) for k in range(size)])
    reference = (
        rows.where(~F.col("base_failed"))
        .groupBy("_lang")
        .agg(
            sums("_classes", len(CLASSES) + 3).alias("_all_classes"),
            sums("_usage", _COMMON + 1).alias("_all_usage"),
        )
    )
    # The distance of a document of other words alone, per language.
    others_alone = F.array(*[F.lit(0.0)] * _COMMON, F.lit(1.0))
    reference = reference.withColumn(
        "_word_limit", MOST_WORD_PART * js_distance(others_alone, _share(F.col("_all_usage")))
    )
    long_enough = (F.col("n_chars") >= GUARD_CHARS) & (F.col("n_words") >= GUARD_WORDS)
    judged = (
        rows.join(reference, "_lang", "left")
        .withColumn(
            "class_distance",
            F.when(long_enough, js_distance(_share(F.col("_classes")), _share(F.col("_all_classes")))),
        )
        .withColumn(
            "word_distance",
            F.when(
                long_enough & F.col("_lang").isin(list(COMMON_WORDS)),
                js_distance(_share(F.col("_usage")), _share(F.col("_all_usage"))),
            ),
        )
    )
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MOST_CLASS_DISTANCE) & (
        (F.coalesce("word_distance", F.lit(0.0)) <= F.coalesce("_word_limit", F.lit(1.0)))
        | (F.col("_word_limit") == 0)
    )
    return judged.select(
        F.col("_id").alias(id_column),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "class_distance",
        "word_distance",
        "base_failed",
        (~F.col("base_failed") & near).alias("kept"),
    )
