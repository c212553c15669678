from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from hearthtab.llm import decontaminate as dc
from hearthtab.llm.queries import op7_decontaminate
from tests.llm import odd

MEDIUM = "/root/testdata/sf0.01"


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()
    items = [dc.Item.of(r["item_id"], r["text"]) for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet").collect()]
    shingled = {}
    for item in items:
        for s in item.shingles:
            shingled.setdefault(s, []).append(item)
    expected = set()
    for d in docs:
        words = dc.words_of(d["text"] or "")
        near = {}
        for k in range(len(words) - 4):
            near |= {i.item_id: i for i in shingled.get(tuple(words[k : k + 5]), ())}
        for item in near.values():
            whole, *parts = item.cover(words)
            if whole >= dc.LEAST_COVER and min(parts) >= dc.LEAST_PART_COVER:
                expected.add((d["doc_id"], item.item_id))
    got = op7_decontaminate(spark, MEDIUM).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected
    assert len(got) == len(expected) > 10


def test_wand_equals_exhaustive_scores():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)]
    items = [dc.Item.of(k, " ".join(rng.sample(words, rng.randrange(3, 20)))) for k in range(50)]
    index = dc.Index(items)
    for threshold in (0.1, 0.3, 0.6):
        for _ in range(60):
            terms = sorted({index.terms[w] for w in rng.sample(words, 30) if w in index.terms})
            scores = Counter()
            for t in terms:
                for item, weight in index.postings[t]:
                    scores[item] += weight
            expected = {i: round(s, 6) for i, s in scores.items() if s >= threshold}
            got = {i: round(s, 6) for i, s in index.search(terms, threshold)}
            assert got == expected
            assert index.reachable(terms, threshold) or not expected
            table, index.block_table = index.block_table, None
            assert index.reachable(terms, threshold) == (table[terms].sum(axis=0).max() >= threshold - 1e-6)
            index.block_table = table


def test_edits_and_casing_are_caught(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    text = f"{fresh(20).capitalize()}? {fresh(10).capitalize()}."
    words = text.split()
    changed = " ".join([*words[:10], "instead", *words[11:]])
    benchmark = spark.createDataFrame([(7, text), (8, None), (9, " "), (10, text)], "item_id long, text string")
    docs = [
        (1, f"{fresh(300)} {text.upper()} {fresh(200)}"),
        (2, f"{fresh(100)} {changed.replace(' ', chr(10))}"),
        (3, f"{fresh(100)} {' '.join(words[:12])} {fresh(50)}"),
        (4, " ".join(rng.sample(words, len(words)))),
        (5, " ".join(words[:20])),
    ]
    found = dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    # Parts of it, other orders, and the question alone are no leaks; equal items are both found.
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 7), (1, 10), (2, 7), (2, 10)]


def test_benchmark_in_parts(spark, monkeypatch):
    whole = {(r["doc_id"], r["item_id"]) for r in op7_decontaminate(spark, MEDIUM).collect()}
    monkeypatch.setattr(dc, "INDEX_CHARS", 3000)
    parts = {(r["doc_id"], r["item_id"]) for r in op7_decontaminate(spark, MEDIUM).collect()}
    assert parts == whole


def test_odd_rows(spark):
    benchmark = spark.createDataFrame([(1, "The same text, twice."), (2, "one")], "item_id long, text string")
    found = dc.find_leaks(odd.table(spark), benchmark).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in found) == {(5, 1): 1, (6, 1): 1, (4, 2): 1}
    assert dc.find_leaks(odd.empty(spark), benchmark).count() == 0
    assert dc.find_leaks(odd.table(spark), benchmark.where("false")).count() == 0


def test_edits_at_every_place_of_items_with_short_parts():
    rng = random.Random(8)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    for sizes in ((30, 1), (30, 4), (25, 2, 3), (2, 30), (31,), (16, 15)):
        item = dc.Item.of(0, " ".join(f"{fresh(n)}." for n in sizes))
        index = dc.Index([item, dc.Item.of(1, fresh(20))])
        words, edited = item.words, []
        for k in range(len(words)):
            edited += [[*words[:k], *x, *words[k + n :]] for x, n in ((["new"], 1), (["new"], 0), ([], 1))]
        edited += [words[: len(words) - k] for k in range(1, 9)] + [words[k:] for k in range(1, 9)]
        for copy in edited:
            text = f"{fresh(40)} {' '.join(copy)} {fresh(40)}"
            assert (0 in dc.matches_in(index, text)) == (item.cover(dc.words_of(text))[0] >= dc.LEAST_COVER)


def test_scores_do_not_depend_on_the_parts(spark, monkeypatch):
    """Term statistics are those of the whole benchmark, copies of an item count once."""
    benchmark = spark.read.parquet(f"{MEDIUM}/benchmark.parquet")
    benchmark = benchmark.unionByName(benchmark.where("item_id % 3 = 0").withColumn("item_id", F.col("item_id") + 10_000))
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rows = lambda: sorted((r["doc_id"], r["item_id"], round(r["score"], 9), r["cover"]) for r in dc.find_leaks(docs, benchmark).collect())
    whole = rows()
    monkeypatch.setattr(dc, "INDEX_CHARS", 3000)
    assert rows() == whole
    monkeypatch.setattr(dc, "FIRST_CLASS", 20)
    assert [r[:2] for r in rows()] == [r[:2] for r in whole]


def test_short_items_are_found_in_texts_of_them_alone(spark):
    benchmark = spark.createDataFrame([(1, "Paris."), (2, "It is Paris"), (3, "!")], "item_id long, text string")
    docs = [(1, "We flew to Paris."), (2, "paris"), (3, "It is  PARIS!"), (4, "")]
    found = dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(2, 1), (3, 2)]


def test_an_index_is_built_once_per_process(monkeypatch):
    built = []
    real = dc.Index.__init__
    monkeypatch.setattr(dc.Index, "__init__", lambda self, *a: (built.append(1), real(self, *a))[1])
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    part = dc.Part([dc.Item.of(k, text(n)) for k, n in enumerate((20, 30, 300, 1000))])
    for _ in range(5):
        assert part.found(text(50)) == {}
    assert len(built) == 3  # one per class of lengths
    long = part.items[3]
    assert part.found(f"{text(400)} {' '.join(long.words)}").keys() == {3}


def test_recall_of_copies_with_four_fifths_of_an_item():
    """Copies whose cover is just enough are retrieved by their weight, too."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.choice((2, 3, 6))))
    common = [word() for _ in range(200)]
    items = [dc.Item.of(k, " ".join(rng.choice(common) if rng.random() < 0.5 else word() for _ in range(rng.randrange(20, 60)))) for k in range(100)]
    part, found, all_ = dc.Part(items), 0, 0
    for item in items:
        for _ in range(10):
            copy = list(item.words)
            n = len(copy)
            size = rng.randrange(1, n // 5 + 1)
            at = rng.randrange(n - size + 1)
            copy[at : at + size] = [word() for _ in range(rng.randrange(2 * size))]
            text = " ".join([rng.choice(common) for _ in range(80)] + copy + [rng.choice(common) for _ in range(80)])
            if item.cover(dc.words_of(text))[0] >= dc.LEAST_COVER:
                all_ += 1
                found += item.item_id in part.found(text)
    assert all_ > 500 and found >= 0.9 * all_
