"""Repeated substrings against brute force over all windows, and the sort against plain sorting."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from hearthtab.llm import induced_sort, substrings
from tests.llm import odd


def _brute(rows, least):
    """Sorted results of rows (identifier, text) that differ in identifier or agree in both or share nothing."""
    held = [(i, (t or "").encode()) for i, t in rows]
    seen = set()
    out = []
    for i, text in sorted(held, key=lambda r: (r[0] is not None, r[0])):
        hit = [False] * len(text)
        for at in range(len(text) - least + 1):
            window = text[at : at + least]
            if window in seen:
                hit[at : at + least] = [True] * least
            seen.add(window)
        spans = sum(h and not (k and hit[k - 1]) for k, h in enumerate(hit))
        kept = bytes(b for b, h in zip(text, hit) if not h)
        out.append((i, len(text), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _found(df):
    columns = ("id" if "id" in df.columns else "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def _texts(seed, n, alphabet):
    pick = random.Random(seed)
    words = ["".join(pick.choice(alphabet) for _ in range(pick.randint(1, 9))) for _ in range(60)]
    passage = [" ".join(pick.choice(words) for _ in range(pick.randint(15, 60))) for _ in range(12)]
    out = []
    for k in range(n):
        parts = [" ".join(pick.choice(words) for _ in range(pick.randint(0, 60)))]
        for _ in range(pick.randint(0, 3)):
            text = pick.choice(passage)
            cut = pick.randint(0, len(text))
            parts += [text[cut:] if pick.random() < 0.5 else text, pick.choice(words)]
        out.append("".join(parts))
    return list(enumerate(pick.sample(out, len(out))))


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij", "aé漢\n"])
def test_as_brute_force(spark, alphabet):
    rows = _texts(len(alphabet), 60, alphabet)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _found(substrings.remove_repeats(df)) == _brute(rows, 100)
    assert _found(substrings.remove_repeats(df, least=40)) == _brute(rows, 40)


def test_texts_are_what_is_left(spark):
    rows = _texts(7, 30, "abcdef")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    for r in substrings.remove_repeats(df, with_text=True).collect():
        text = bytearray(texts[r.doc_id].encode())
        for span in reversed(r.spans):
            del text[span.start : span.end]
        assert bytes(text) == bytes(r.kept)
        assert hashlib.sha256(text).hexdigest() == r.kept_sha256


def test_repeats_inside_a_text_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_STRETCH", 4096)
    monkeypatch.setattr(substrings, "_PLACE", np.uint64(4095))
    pick = random.Random(3)
    line = "".join(pick.choice("abcdefgh ") for _ in range(150))
    noise = "".join(pick.choice("abcdefgh ") for _ in range(9000))
    rows = [(1, "x" * 5000), (2, (line + noise[:77]) * 40), (3, noise), (4, noise[3000:] + line), (5, "xy" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _found(substrings.remove_repeats(df)) == _brute(rows, 100)


def test_hot_hashes_are_dealt_as_single_windows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SAMPLE_OF", 1)
    monkeypatch.setattr(substrings, "HOT_IN_SAMPLE", 3)
    pick = random.Random(5)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(pick.randint(20, 120)))
    line = "This line of about sixty bytes stands in very many of the texts."
    rows = [(k, word() + line + word()) for k in range(60)]
    rows += [(100 + k, rows[k][1][5:]) for k in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(substrings._hot_keys(
        df.selectExpr("doc_id as id", "xxhash64(doc_id, 1, text) as row", "text"), df.schema["doc_id"].dataType, 100
    ))
    assert _found(substrings.remove_repeats(df)) == _brute(rows, 100)


def test_small_batches_keep_what_is_held_back(spark):
    rows = _texts(11, 60, "abcd")
    rows += [(1000 + k, t) for k, t in rows[:20]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = _found(substrings.remove_repeats(df))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert found == _brute(rows, 100)


def test_odd_rows(spark):
    long_ = "The same long text with an own ending, again and again, " * 5
    held = odd.rows()
    held += [("clash", i, -1, long_, "clash", "en", "clash", "") for i in (7, 7, None, None, 8)]
    rows = [(r[1], r[3]) for r in held]
    df = spark.createDataFrame(held, odd.SCHEMA)
    assert _found(substrings.remove_repeats(df)) == _brute(rows, 100)
    named = spark.createDataFrame([(str(i), t) for i, t in rows], "id string, body string")
    assert _found(substrings.remove_repeats(named, "id", "body")) == _brute([(str(i), t) for i, t in rows], 100)


def test_empty_table(spark):
    assert substrings.remove_repeats(odd.empty(spark)).collect() == []


@pytest.mark.parametrize("in_memory", [1 << 20, 0])
def test_sort_against_plain_sorting(monkeypatch, in_memory):
    monkeypatch.setattr(induced_sort, "IN_MEMORY", in_memory)
    monkeypatch.setattr(induced_sort, "IN_MEMORY_SYMBOLS", in_memory)
    pick = random.Random(in_memory)
    for k in range(150):
        text = [pick.randint(1, pick.choice([1, 2, 3, 9])) for _ in range(pick.randint(1, 60))]
        text = np.array(text * (3 if k % 3 == 0 else 1) + [0], np.uint8)
        want = sorted(range(len(text)), key=lambda i: list(text[i:]))
        assert induced_sort.suffix_order(text, 10).tolist() == want
        down, shared = induced_sort.suffixes_with_prefixes(text, 10)
        assert down.tolist() == want[1:][::-1]
        for one, two, n in zip(down[:-1], down[1:], shared[1:]):
            pairs = zip(text[one:], text[two:])
            assert n == next((i for i, (a, b) in enumerate(pairs) if a != b), 999)


def test_long_runs_are_sorted_in_blocks(monkeypatch):
    monkeypatch.setattr(induced_sort, "CHUNK", 64)
    text = np.array([3] * 700 + [1] + [2] * 900 + [3] * 500 + [0], np.uint8)
    want = sorted(range(len(text)), key=lambda i: list(text[i:]))
    assert induced_sort.suffix_order(text, 4).tolist() == want
