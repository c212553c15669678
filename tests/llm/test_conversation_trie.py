"""The trie against brute force over all prefixes; list ranking against a walk along the list."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from hearthtab.llm import conversation_trie as trie
from hearthtab.llm import queries
from hearthtab.llm.oracle import trie_sql
from hearthtab.operators.skew import SkewLimits
from tests.compare import oracle_rows, spark_rows

SCHEMA = "conv_id long, turn long, role string, text string"


def _brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []

    def walk(node):
        below = [walk(child) for child in children[node]]
        leaves = sum(b[0] for b in below) if below else 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved = own + sum(b[1] for b in below)
        ends = ",".join(map(str, sorted(c for c, s in rebuilt.items() if tuple(s) == node)))
        out.append((
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]),
            len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
        return leaves, saved

    if members:
        walk(())
    return sorted(out, key=repr)


def _found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _rows(seed, n, kinds=4, longest=12):
    pick = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(pick.randint(0, longest)):
            rows.append((c, t, pick.choice(["user", "assistant", None]), pick.choice(["é" * k for k in range(kinds)] + [None])))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    rows = _rows(seed, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert _found(trie.prefix_trie(df)) == _brute(rows)


def test_heavy_conversations_and_parents_and_a_long_tour(spark):
    rows = _rows(3, 50, kinds=2) + [(51, t, "user", str(t % 7)) for t in range(150)]
    rows += [(51, 5, "user", "again"), (51, 5, "user", "again")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = trie.prefix_trie(df, SkewLimits(rows_per_task=5), arcs_per_task=40, short_list=20)
    assert _found(found) == _brute(rows)


def test_equal_conversations(spark):
    rows = [(c, t, "user", "same") for c in range(0, 400, 5) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert _found(trie.prefix_trie(df, SkewLimits(rows_per_task=50))) == _brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "nobody's"), (7, None, None, None), (7, None, None, None), (7, 1, "", ""), (9, 1, "user", ""),
        (11, 1, "user", "x" * 200_000), (12, 2, "user", "\x00\x1f"), (12, 2, "user", "漢字"), (-3, 1, "user", "a"), (-5, 1, "u", "b"),
        (3, 1, "ab", "c"), (4, 1, "a", "bc"), (1, 1, "user", "turn"), (6, 1, "user", "turn"), (2**40, 1, "user", "turn"),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA + ", conv string, Text string")
    assert _found(trie.prefix_trie(df)) == _brute(rows)


def test_conversations_without_rebuilt_turns(spark):
    rows = [(c, 1, "user", "short") for c in range(1, 60) if c % 5]
    assert _found(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == _brute(rows)


def test_empty_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ranking_of_a_shuffled_list(spark):
    pick = random.Random(4)
    order = list(range(3000))
    pick.shuffle(order)
    rows = [(a, b, pick.randint(0, 3), pick.randint(0, 1000)) for a, b in zip(order, [*order[1:], None])]
    want, leaf, saved = {}, 0, 0
    for a, _, x, y in rows:
        want[a] = (leaf, saved)
        leaf, saved = leaf + x, saved + y
    df = spark.createDataFrame(rows, "arc long, next long, leaf long, saved long")
    found = {r.arc: (r.before_leaf, r.before_saved) for r in trie.rank_tour(df, 700, 500).collect()}
    assert found == want


def test_as_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    found = spark_rows(queries.op12_prefix_trie(spark, small))
    assert found == oracle_rows(con, trie_sql())
    assert found[1]
