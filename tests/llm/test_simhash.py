from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from hearthtab.llm import simhash
from hearthtab.llm.queries import op5_simhash
from tests.llm import odd


def brute_print(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else []
    shingles = shingles or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest identifier reachable, from a list of (identifier, fingerprint)."""
    parent = list(range(len(prints)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(prints):
        groups[root(k)].append(i)
    return [min((i for i in groups[root(k)] if i is not None), default=None) for k in range(len(prints))]


def test_query_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    prints = [(d["doc_id"], brute_print(d["text"])) for d in docs]
    expected = {i: (f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints), strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op5_simhash(spark, small).collect()}
    assert got == expected


def near_prints(count, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    found = set()
    while len(found) < count:
        value = rng.choice(centres)
        for _ in range(rng.randrange(6)):
            value ^= 1 << rng.randrange(64)
        found.add(value)
    return sorted(found)


def grouped(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[root(a)] = root(b)
    groups = defaultdict(set)
    for n in nodes:
        groups[root(n)].add(n)
    return {frozenset(g) for g in groups.values()}


def brute_groups(values):
    return grouped(
        [(a, b) for k, a in enumerate(values) for b in values[:k] if (a ^ b).bit_count() <= 3], values
    )


def test_bit_sliced_run_equals_all_pairs():
    values = near_prints(500, 1)
    a, b = simhash.links_in_run(np.zeros(len(values), np.int64), np.array(values, np.uint64))
    assert grouped(zip(a.tolist(), b.tolist(), strict=True), values) == brute_groups(values)
    assert len(a) < len(values)


def test_runs_do_not_mix():
    values = np.array([5, 5, 7, 7, 7], np.uint64)
    a, b = simhash.links_in_run(np.array([1, 2, 3, 3, 4]), values)
    assert (a.tolist(), b.tolist()) == ([7], [7])


@pytest.mark.parametrize("part", [8, simhash.PART])
def test_links_over_keys_and_tiles(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    values = near_prints(400, 2)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "_fp long")).collect()
    pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links]
    assert grouped(pairs, values) == brute_groups(values)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)]
    edges = [e for e in edges if e[0] != e[1]]
    nodes = {n for e in edges for n in e}
    got = simhash.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {n: min(g) for g in grouped(edges, nodes) for n in g}
    assert len(got) == len(nodes)


def test_odd_rows(spark):
    rows = simhash.near_duplicates(odd.table(spark)).collect()
    prints = [(i, brute_print(t)) for i, t in odd.TEXTS]
    order = lambda r: tuple(-(1 << 70) if x is None else x for x in r)
    expected = [(i, p, c) for (i, p), c in zip(prints, brute_components(prints), strict=True)]
    got = [(r["doc_id"], r["fingerprint"] % (1 << 64), r["component"]) for r in rows]
    assert sorted(got, key=order) == sorted(expected, key=order)
    assert simhash.near_duplicates(odd.empty(spark)).count() == 0
