"""Alignment against plain loops over all pairs of tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from hearthtab.llm import alignment
from tests.llm import odd

A_FILE = public_tokenizers.path("byte_bpe_50k.json")
B_FILE = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B_FILE)


def _intervals(encoders, text):
    """(start, end, id) of both sides, or None."""
    a, b = encoders
    byte = {s: v for s, v in alignment._byte_of_symbol().items()}
    out = []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    out.append([(bytes(byte[c] for c in a.id_to_token(i)), i) for i in ids])
    pieces = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        pieces.append((bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode(), i))
    out.append(pieces)
    if not text or any(b"".join(p for p, _ in side) != b" " + text.encode() for side in out):
        return None
    places = []
    for side in out:
        at, held = 0, []
        for piece, i in side:
            held.append((at, at + len(piece), i))
            at += len(piece)
        places.append(held)
    return places


def _brute(encoders, rows):
    found, holds = [], Counter()
    for _, text in rows:
        both = _intervals(encoders, text or "")
        if both is None:
            found.append(None)
            continue
        a, b = both
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, low = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for s, _, i in side if low <= s < end) for side in both))
            low = end
        links = [(i, j) for s, e, i in a for t, f, j in b if s < f and t < e]
        holds.update(set(links))
        found.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (i, _), n in holds.items():
        most[i] = max(most[i], n)
    out = []
    for (doc, _), f in zip(rows, found):
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        out.append((
            doc, n_a, n_b, len(groups), len(links), sum(holds[k] == most[k[0]] for k in links),
            sum(holds[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def _found(df, columns=COLUMNS):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def _texts(n):
    pick = random.Random(n)
    words = ["hello", "naïve", "Straße", "12345", "  ", "\n\n", "don't", "<s>", "<|endoftext|>", "漢字", "😀", "▁", "\x00",
             "internationalisation", "...", " ", "\u0085", "　", "é", "ﬁ", "\x1c", "aaaa", "\t", "\r\n"]
    return [(k, "".join(pick.choice(words) + pick.choice(["", " "]) for _ in range(pick.randint(0, 25)))) for k in range(n)]


@pytest.mark.parametrize("chunk", [alignment.CHUNK_BYTES, 200])
def test_as_brute_force(spark, encoders, monkeypatch, chunk):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(alignment, "SLICE_BYTES", min(chunk // 3, alignment.SLICE_BYTES))
    rows = _texts(120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _found(alignment.align_tokenizers(df, A_FILE, B_FILE)) == _brute(encoders, rows)


def test_whole_documents(spark, encoders, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.where("length(text) < 2500").collect()]
    df = docs.where("length(text) < 2500")
    assert _found(alignment.align_tokenizers(df, A_FILE, B_FILE)) == _brute(encoders, rows)


def test_groups_as_text(spark):
    df = spark.createDataFrame([(1, "Hello worlds")], "doc_id long, text string")
    row = alignment.align_tokenizers(df, A_FILE, B_FILE, with_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256
    assert row.groups.count(";") + 1 == row.n_groups


def test_common_characters_are_split_alike(encoders):
    side = alignment.ByteLevel(A_FILE)
    pick = random.Random(9)
    common = [chr(c) for c in range(0x250) if alignment._COMMON(chr(c))]
    texts = ["".join(pick.choice(common) for _ in range(60)) for _ in range(300)]
    want = [encoders[0].encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert side.encode(texts) == want


def test_odd_rows(spark, encoders):
    rows = [(r[1], r[3]) for r in odd.rows() if len(r[3] or "") < 1000]
    df = odd.table(spark).toDF("a", "doc_id", "b", "text", "c", "d", "e", "f").where("coalesce(length(text), 0) < 1000")
    assert _found(alignment.align_tokenizers(df, A_FILE, B_FILE)) == _brute(encoders, rows)
    assert alignment.align_tokenizers(odd.table(spark), A_FILE, B_FILE).count() == len(odd.rows())
    named = df.selectExpr("cast(doc_id as string) as id", "text as body")
    found = alignment.align_tokenizers(named, A_FILE, B_FILE, "id", "body")
    want = sorted(((None if r[0] is None else str(r[0]), *r[1:]) for r in _brute(encoders, rows)), key=repr)
    assert _found(found, ("id", *COLUMNS[1:])) == want


def test_empty_table(spark):
    assert alignment.align_tokenizers(odd.empty(spark), A_FILE, B_FILE).collect() == []
