from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest

from hearthtab.llm import sharding
from hearthtab.llm.queries import op10_sharding
from tests.llm import odd


def check_law(rows, shards):
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query_matches_single_places(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op10_sharding(spark, small).collect()
    number = {i: k for k, i in enumerate(sorted(docs))}
    assert len(rows) == len(docs)
    check_law(rows, 8)
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        assert sharding.place_of(number[r["doc_id"]], len(docs)) == (r["shard"], r["slot"])
        assert (r["law"], r["grown_shard"]) == ("rows", None)


@pytest.mark.parametrize("total", [1, 2, 3, 7, 64, 1000, 4099])
def test_permutation_and_its_inverse(total):
    places = [sharding.place_of(k, total, 3) for k in range(total)]
    assert len(set(places)) == total
    assert [sharding.row_at(*p, total, 3) for p in places] == list(range(total))


def test_odd_rows(spark):
    rows = sharding.shard_rows(odd.table(spark), shards=3).collect()
    check_law(rows, 3)
    expected = Counter((i, len((t or "").encode()) + 1) for i, t in odd.TEXTS)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == expected
    assert sharding.shard_rows(odd.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_rows(odd.table(spark), shards=0)


def test_copies_are_dealt_out(spark):
    rows = sharding.shard_rows(spark.sql("SELECT 5L AS doc_id, 'x' AS text FROM range(0, 1000, 1, 7)"), 4)
    check_law(rows.collect(), 4)
