from __future__ import annotations

import hashlib
import random
import re
from itertools import product

import numpy as np
import pytest

from hearthtab.llm import pii
from hearthtab.llm.queries import op8_pii
from tests.llm import odd

MEDIUM = "/root/testdata/sf0.01"
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return (
        kind == 0
        or (kind == 1 and all(int(p) <= 255 for p in value.split(".")))
        or (kind == 2 and 14 <= len(digits) <= 19 and pii.luhn(digits))
        or (kind == 3 and 10 <= len(digits) <= 15)
    )


def brute(text):
    return sorted(
        (m.start(), k, m.end())
        for k, p in enumerate(PATTERNS)
        for m in re.finditer(p, text or "")
        if valid(k, m[0])
    )


def test_base_spans_equal_the_patterns():
    random.seed(11)
    parts = ["a", "Z", "@", ".", "1", "25", "4111 1111 1111 1111", "-", " ", "+49 ", "(0", "é", "%", "_",
             "999", "+", "127.0.0.1", "0001.2.3.4"]
    for _ in range(4000):
        text = "".join(random.choices(parts, k=14))
        assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 4000 + "x" + "@" * 50_000, "a@" * 50_000, "+1 " * 50_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def network(spark):
    return pii.fit(spark.read.parquet(f"{MEDIUM}/documents.parquet"))


def test_query_keeps_base_spans(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = op8_pii(spark, MEDIUM).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = brute(docs[r["doc_id"]])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["n_email"] == sum(k == 0 for _, k, _ in spans)
        assert set(text.split(",")) <= set(r["spans"].split(","))


def test_network_finds_unseen_spans(spark, network):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    hit = total = 0
    for text in texts[1000:4000]:
        base = set(pii.base_spans(text))
        if base:
            total += len(base)
            hit += len(base & set(pii.propose(network, text, pii.regions_of(text))))
    assert total > 50 and hit >= 0.8 * total


def test_network_adds_other_forms(network):
    spans = pii.find_in("thonly call (212) 555-0187 and then the rest of it", network)
    assert [(k, base) for _, k, _, base in spans] == [(3, False)]
    assert pii.find_in("on 2024-01-15 the total was 12345678 of all", network) == []


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    network = pii.Network.new(1)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    x, y = rng.integers(0, pii.CLASSES, (3, 7)), rng.integers(0, len(pii.TAGS), (3, 7))
    _, grads = network.gradients(x, y)
    for name, value in network.p.items():
        for _ in range(4):
            place = tuple(int(rng.integers(s)) for s in value.shape)
            old = value[place]
            losses = []
            for change in (1e-3, -1e-3):
                value[place] = old + change
                losses.append(network.gradients(x, y)[0])
            value[place] = old
            assert abs((losses[0] - losses[1]) / 2e-3 - grads[name][place]) < 2e-3


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    emit, move = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    score = lambda p: sum(emit[0, t, k] for t, k in enumerate(p)) + sum(
        move[a, b] for a, b in zip(p, p[1:], strict=False)
    )
    assert tuple(pii.viterbi(emit, move)[0]) == max(product(range(3), repeat=4), key=score)


def test_odd_rows(spark, network):
    rows = pii.find_personal_data(odd.table(spark), network).collect()
    assert len(rows) == len(odd.TEXTS)
    assert pii.find_personal_data(odd.empty(spark), network).count() == 0
    assert pii.fit(odd.empty(spark)) is None
    long_numbers = " ".join(["4111 1111 1111 1111"] * 3000)
    frame = spark.createDataFrame([(1, long_numbers)], "doc_id long, text string")
    (row,) = pii.find_personal_data(frame, network).collect()
    assert [(s["start"], s["rank"], s["end"]) for s in row["spans"] if s["base"]] == brute(long_numbers)
