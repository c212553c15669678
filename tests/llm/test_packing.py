from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hearthtab.llm import packing
from hearthtab.llm.queries import TOKENIZER, op3_packing
from tests.llm import odd

FILE = public_tokenizers.path(TOKENIZER)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def check_pieces(pieces, ids_of_rows):
    """Pieces rebuild the rows, sequences are gapless and short enough."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for sequence in by_sequence.values():
        sequence.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in sequence] == list(np.cumsum([0] + [p["length"] for p in sequence[:-1]]))
        assert sum(p["length"] for p in sequence) <= packing.WINDOW
    assert by_doc.keys() == ids_of_rows.keys()
    return by_doc, by_sequence


def test_query_round_trip(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    ids = {
        d["doc_id"]: np.array(tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        for d in docs
    }
    by_doc, by_sequence = check_pieces(op3_packing(spark, small).collect(), ids)
    for doc_id, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids[doc_id]))
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[doc_id][p["start"] : at].tobytes())
        assert at == len(ids[doc_id])
    lengths = np.array([sum(p["length"] for p in s) for s in by_sequence.values()])
    whole = lengths[np.bitwise_count(lengths) != 1]
    assert (packing.WINDOW - whole).sum() < 0.03 * lengths.sum()


def test_words_encode_like_whole_texts(tokenizer):
    encoder = packing.Encoder(FILE)
    random.seed(7)
    letters = "abzAZéÉßñ0½9²'.,!-_<|>\xa0\x85\x1c \n\tńİΣΣς漢ǅªº\xad́'"
    for _ in range(1500):
        text = "".join(random.choice(letters) for _ in range(14)) + random.choice(
            ["", "'ll", "<|endoftext|>", " DON'T", "<|startoftext|>x"]
        )
        expected = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode([text])[0][0].tolist() == expected


def brute_cost(pos, fine, window):
    best = {0: 0}
    for j in range(1, len(pos)):
        options = [
            best[i] + (0 if j == len(pos) - 1 else window - (pos[j] - pos[i]) + fine[j])
            for i in range(j)
            if pos[j] - pos[i] <= window
        ]
        best[j] = min(options)
    return best[len(pos) - 1]


def test_cuts_are_the_cheapest():
    random.seed(3)
    for _ in range(200):
        steps = [random.randint(1, 9) for _ in range(random.randint(1, 14))]
        places = np.cumsum(steps)
        fines = np.array([random.choice([0, 2, 5]) for _ in steps])
        window = 12
        starts = packing.best_cuts(places, fines, window)
        pos, fine = [0, *places.tolist()], {0: 0} | dict(zip(places.tolist(), fines.tolist(), strict=True))
        stops = [*starts[1:], pos[-1]]
        assert starts[0] == 0 and all(b - a <= window for a, b in zip(starts, stops, strict=True))
        cost = sum(window - (b - a) + fine[b] for a, b in zip(starts, stops, strict=True) if b != pos[-1])
        assert cost == brute_cost(pos, [0, *fines.tolist()], window)


def test_parts_of_a_power_of_two():
    assert packing.power_of_two_parts(3001) == [2048, 512, 256, 128, 32, 16, 8, 1]
    assert packing.power_of_two_parts(0) == []


def test_odd_rows(spark, tokenizer):
    pieces = packing.pack_documents(odd.table(spark), FILE).collect()
    expected = defaultdict(int)
    for i, t in odd.TEXTS:
        expected[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    by_doc, _ = check_pieces(pieces, expected)
    assert {i: sum(p["length"] for p in ps) for i, ps in by_doc.items()} == expected
    assert packing.pack_documents(odd.empty(spark), FILE).count() == 0


def test_identifiers_of_any_type(spark, tokenizer):
    df = spark.createDataFrame([("a", "One text."), (None, "Another one."), ("b", None)], "doc_id string, text string")
    found = {(r.doc_id, r.doc_tokens) for r in packing.pack_documents(df, FILE).collect()}
    tokens = {t: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in ("One text.", "Another one.", None)}
    assert found == {("a", tokens["One text."]), (None, tokens["Another one."]), ("b", tokens[None])}


def test_one_encoder_per_process():
    assert packing.Encoder.loaded(FILE) is packing.Encoder.loaded(FILE)


def test_both_encoders_agree(tokenizer):
    """Parts of real texts, of random letters and of marks: all in one call, and one by one."""
    encoder = packing.Encoder(FILE)
    pick = random.Random(12)
    letters = "etaoinshrdlucmfwypvbgkjqxz" + "éèüöäñßçøåæ" + "0123456789" + ".,!?'-_()/\\\"#*"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(1, 14))) for _ in range(40_000)]
    texts += ["a" * k for k in range(1, 60)] + ["aba" * k for k in range(1, 30)] + ["don't 've 'LL it's", " ", "", "\n"]
    texts += ["".join(pick.choice([w, w.upper(), " "]) for w in pick.sample(texts, 30)) for _ in range(500)]
    assert all(packing._PLAIN(t) for t in texts) and encoder._merges is not None
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    fast = encoder.encode(texts)
    slow = encoder._encode_words(texts)
    assert [ids.tolist() for ids, _ in fast] == want
    assert [ids.tolist() for ids, _ in slow] == want
    assert all(a.tolist() == b.tolist() for (_, a), (_, b) in zip(fast, slow))
