from __future__ import annotations

from hearthtab.llm import language_id
from hearthtab.llm.queries import op2_language_id
from tests.llm import odd

MEDIUM = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in op2_language_id(spark, MEDIUM).collect()}
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()
    assert rows.keys() == {d["doc_id"] for d in docs}
    unseen = [d for d in docs if rows[d["doc_id"]]["held_out"]]
    right = sum(rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in unseen)
    assert right >= 0.98 * len(unseen)
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_counts_equal_plain_counting(spark):
    rows = [(1, "aB, a", "x"), (2, "ba", "y"), (3, None, "x"), (4, "q", None)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    grams, _, _ = language_id.NGrams()(["aB, a"])
    assert model.languages == ("x", "y")
    # " ab a " has 3 letters, 5 pairs, 4 triples and 3 fours.
    assert sum(len(g) for g in grams) == 3 + 5 + 4 + 3
    total = 15 + language_id.SMOOTHING * language_id.BUCKETS
    assert abs(model.log_prob[grams[3][0], 0] - __import__("math").log(1.5 / total)) < 1e-5


def test_odd_rows(spark):
    docs = odd.table(spark)
    model = language_id.fit(docs)
    rows = language_id.predict(docs, model).collect()
    assert len(rows) == len(odd.TEXTS)
    blank = {1, 2, 3}
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in blank) for r in rows if r["doc_id"])
    assert language_id.fit(odd.empty(spark)) is None
    assert language_id.predict(odd.empty(spark), model).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}
