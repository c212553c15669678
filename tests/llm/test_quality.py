from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from hearthtab.llm import quality
from hearthtab.llm.oracle import quality_sql
from hearthtab.llm.queries import op6_quality
from tests.compare import oracle_rows, spark_rows
from tests.llm import odd


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(k, k + 8))
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered),
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_query_equals_brute_force_and_oracle(spark, small):
    rows = op6_quality(spark, small)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in rows.collect():
        expected = brute(docs[r["doc_id"]])
        assert tuple(r[n] for n in NAMES) == expected
        assert r["base_failed"] == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r["kept"] and r["base_failed"])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert spark_rows(rows) == oracle_rows(con, quality_sql())


def test_good_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1")
    rows = op6_quality(spark, folder).join(labels, "doc_id").where("NOT base_failed AND NOT kept")
    assert rows.count() == 0


def test_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    row = spark.range(1).select(
        quality.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d")
    )
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    assert abs(row.first()["d"] - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12


def test_repeats(spark):
    texts = [" ".join("a b c d e f g h i".split() * k) for k in (1, 2, 3)] + ["x " * 9, "x " * 8]
    frame = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality.judge_quality(frame).collect():
        assert tuple(r[n] for n in NAMES) == brute(texts[r["doc_id"]])


def test_odd_rows(spark):
    rows = quality.judge_quality(odd.table(spark)).collect()
    assert len(rows) == len(odd.TEXTS)
    got = Counter((r["doc_id"], *(r[n] for n in NAMES)) for r in rows)
    assert got == Counter((i, *brute(t)) for i, t in odd.TEXTS)
    assert quality.judge_quality(odd.empty(spark)).count() == 0


def test_documents_without_common_words_go(spark):
    """Labelled-bad lists without a common word are rejected by the words; good documents never are."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality IS NOT NULL")
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    rows = [r for r in op6_quality(spark, folder).join(labels, "doc_id").join(texts, "doc_id").collect() if not r["base_failed"]]
    without = [
        r for r in rows
        if r["word_distance"] is not None and not set(r["text"].split()) & set(quality.COMMON_WORDS[r["lang"]])
    ]
    assert len(without) > 50 and not any(r["kept"] for r in without)
    by_words = [r for r in rows if not r["kept"] and r["class_distance"] <= quality.MOST_CLASS_DISTANCE]
    assert len(by_words) > 50 and all(r["quality"] == 0 for r in rows if not r["kept"])


def test_a_language_without_common_words_in_use(spark):
    """Where no document has a common word, words reject none."""
    text = " ".join(f"wort{k % 37}x{k}" for k in range(200))
    frame = spark.createDataFrame([(k, f"{text} {k}", "de") for k in range(4)], "doc_id long, text string, lang string")
    assert all(r["kept"] for r in quality.judge_quality(frame).collect())
