from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from hearthtab.llm import toxicity as tx
from hearthtab.llm.queries import op9_toxicity
from tests.llm import odd

LARGE = "/root/testdata/sf0.1"


def brute_features(word):
    codes, found = tx.codes(word), defaultdict(float)
    for places in combinations(range(len(codes)), tx.ORDER):
        stretch = places[-1] - places[0] + 1
        if stretch <= tx.SPAN:
            found[tuple(codes[k] for k in places)] += tx.DECAY**stretch
    norm = np.sqrt(sum(v * v for v in found.values()))
    return {k: v / norm for k, v in found.items()}


def test_kernel_equals_brute_force():
    words = ["^idiot^", "^idixot^", "^thing^", "^aaaaaa^", "^nothing^"]
    kernel = tx.kernel_with(words, words)
    features = [brute_features(w) for w in words]
    for i, a in enumerate(features):
        for j, b in enumerate(features):
            assert abs(kernel[i, j] - sum(v * b.get(k, 0) for k, v in a.items())) < 1e-5
    # Inserted characters cost less than other words.
    assert kernel[0, 1] > 2 * kernel[0, 4]


def made_sample():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdeghlmnorstu"), 7))
    sample = []
    for k in range(400):
        words = {tx.normal(word()) for _ in range(30)} | {tx.normal("weather")}
        if k % 4 == 0:
            words.add(tx.normal(["wretch", "zombie"][k % 8 // 4]))
        sample.append((k % 4 == 0, sorted(words), (k,)))
    return sample


@pytest.fixture(scope="module")
def model():
    return tx.learn(tx.gather(iter(made_sample())))


def test_learns_words_from_document_labels(model):
    scorer = tx.Scorer(model)
    margin = scorer(["a wretch here", "Zombie!", "w.r.e.t.c.h", "fine weather", "", "x"])
    assert (margin[:3] > 0).all() and (margin[3:] < 0).all()


def test_weights_equal_the_kernel_machine():
    words = [w for _, ws, _ in made_sample()[:30] for w in ws][:120]
    landmarks = words[:20]
    values, vectors = np.linalg.eigh(tx.kernel_with(landmarks, landmarks))
    root = vectors / np.sqrt(np.maximum(values, 1e-9))
    labels = np.arange(len(words)) < 40
    w = tx.train_svm(tx.kernel_with(words, landmarks) @ root, labels, np.ones(len(words)))
    alpha = root @ w[:-1]
    dense = np.zeros(tx.SYMBOLS**tx.ORDER)
    for row, a in zip(tx.feature_rows(landmarks), alpha, strict=True):
        for n, v in row.items():
            dense[n] += a * v
    direct = tx.kernel_with(words, landmarks) @ alpha + w[-1]
    assert np.allclose(tx.ToxicityModel(dense, w[-1]).margins(words), direct, atol=1e-3)


def test_copies_are_no_evidence():
    sample = made_sample()
    # One toxic document a hundred times over: its own words prove nothing.
    copy = (True, [tx.normal(x) for x in ("wretch", "quirkily", "vexingly")], (10_000,))
    model = tx.learn(tx.gather(iter(sample + [copy] * 100)))
    assert (tx.Scorer(model)(["quirkily", "vexingly"]) < 0).all()


def test_one_label_gives_no_model(spark):
    clean = [row for row in made_sample() if not row[0]]
    assert tx.learn(tx.gather(iter(clean))) is None
    labels = spark.createDataFrame([(5, 0), (6, 0), (7, None)], "doc_id long, toxic int")
    assert tx.fit(odd.table(spark), labels) is None


def test_held_out_documents(spark):
    rows = op9_toxicity(spark, LARGE)
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "lang", "text")
    unseen = rows.where("held_out").join(labels, "doc_id").join(docs, "doc_id").collect()
    clean = [r for r in unseen if r["toxic"] == 0]
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    for lang in ("en", "fr", "de", "es"):
        toxic = [r for r in unseen if r["toxic"] == 1 and r["lang"] == lang]
        assert toxic and sum(r["predicted"] for r in toxic) >= 0.7 * len(toxic)
    assert rows.count() == docs.count()


def test_odd_rows(spark, model):
    rows = tx.score_toxicity(odd.table(spark), model).collect()
    assert len(rows) == len(odd.TEXTS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert tx.score_toxicity(odd.empty(spark), model).count() == 0
    assert {r["predicted"] for r in tx.score_toxicity(odd.table(spark), None).collect()} == {0}


def test_quoted_insults_and_wrong_labels():
    """A clean document that quotes every insult, and one label in fifty wrong, hide no insult."""
    rng = np.random.default_rng(3)
    sample = [(bool(toxic) != (rng.random() < 0.02), *rest) for toxic, *rest in made_sample()]
    sample.append((False, [tx.normal(x) for x in ("wretch", "zombie", "quoted")], (9_999,)))
    scores = tx.Scorer(tx.learn(tx.gather(iter(sample))))(["a wretch here", "zombie", "fine weather", "quoted", ""])
    assert (scores[:2] > 0).all() and (scores[2:] < 0).all()


def test_words_that_also_occur_by_chance_need_others():
    """Toxic documents hold several words of a kind of which clean ones have one now and then."""
    rng = np.random.default_rng(4)
    syllables = ["ba", "do", "ki", "lu", "me", "no", "ra", "si", "tu", "vo"]
    word = lambda n: "".join(rng.choice(syllables, n))
    kind = lambda: "zanq" + word(2)
    sample = []
    for k in range(900):
        words = {tx.normal(word(4)) for _ in range(40)}
        toxic = k % 6 == 0
        for _ in range(6 if toxic else int(rng.random() < 0.08)):
            words.add(tx.normal(kind()))
        sample.append((toxic, sorted(words), (k,)))
    scorer = tx.Scorer(tx.learn(tx.gather(iter(sample))))
    text = lambda n: " ".join([word(4) for _ in range(40)] + [kind() for _ in range(n)])
    assert (scorer([text(6) for _ in range(50)]) > 0).mean() > 0.9
    assert (scorer([text(0) for _ in range(50)]) > 0).sum() == 0
    assert (scorer([text(1) for _ in range(50)]) > 0).mean() < 0.2
