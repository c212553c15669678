from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline as cp
from hearthtab.llm import decontaminate as dc
from hearthtab.llm.common import staged
from tests.llm import odd
from tests.llm.test_secrets import brute as secret_spans
from tests.llm.test_simhash import brute_components, brute_print

MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before each stage, and the last stage's."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for name, stage in cp.STAGES:
        docs = staged(stage(spark, docs, MEDIUM), "test_stage")
        assert docs.columns == columns or name == "packing"
        seen.append(docs.collect())
    return seen


def test_registered():
    assert [name for name, _ in cp.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "secrets", "packing",
    ]
    assert contract.queries()["pipeline"] is cp.run
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in contract.queries()}


def test_toxicity_leaves_clean_documents(spark, stages):
    kept = {r["doc_id"] for r in stages[1]}
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    clean = [i for i, t in label.items() if t == 0]
    assert sum(i not in kept for i in clean) <= 0.01 * len(clean)
    insults = re.compile(r"\b(idiot|loser|pathetic|clown)\b", re.I)
    caught = [r["doc_id"] for r in stages[0] if insults.search(r["text"])]
    assert sum(i not in kept for i in caught) >= 0.9 * len(caught)


def test_one_of_each_group_stays(stages):
    before, after = stages[1], stages[2]
    prints = [(r["doc_id"], brute_print(r["text"])) for r in before]
    assert {r["doc_id"] for r in after} == set(brute_components(prints))
    assert len(after) == len({r["doc_id"] for r in after})


def test_leaks_go(spark, stages):
    items = [dc.Item.of(r["item_id"], r["text"]) for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet").collect()]
    index = dc.Index(sorted(items, key=lambda i: i.words))
    expected = {r["doc_id"] for r in stages[2] if not dc.matches_in(index, r["text"])}
    assert {r["doc_id"] for r in stages[3]} == expected


def test_secrets_are_masked(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3]}
    assert {r["doc_id"] for r in stages[4]} == before.keys()
    changed = 0
    for r in stages[4]:
        text = before[r["doc_id"]]
        done, at = "", 0
        for start, _, end, kind in secret_spans(text):
            if start >= at:
                done += f"{text[at:start]}[{kind}]"
            at = max(at, end)
        changed += bool(at)
        assert r["text"] == done + text[at:]
        assert r["n_chars"] == len(r["text"])
    assert changed


def test_packing_round_trip(spark, stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(cp.TOKENIZER))
    pieces = defaultdict(int)
    for p in stages[5]:
        pieces[p["doc_id"]] += p["length"]
    expected = {
        r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in stages[4]
    }
    assert pieces == expected
    lengths = np.array([p["length"] for p in cp.run(spark, MEDIUM).collect()])
    assert lengths.sum() == sum(expected.values())


def test_odd_rows(spark):
    names = ("_row", "doc_id", "spans", "text", "_c0", "lang", "blob", "_copies")
    docs = odd.table(spark).toDF(*names)
    for name, stage in cp.STAGES:
        after = staged(stage(spark, docs, MEDIUM), "test_odd")
        assert stage(spark, docs.limit(0), MEDIUM).count() == 0
        if name == "packing":
            break
        assert after.columns == docs.columns
        docs = after
    # 5 and 6 are copies, so are the two rows of 7, and the four blank texts.
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == sorted(["None", "None", "4", "5", "7", "8", "9", "10"])
