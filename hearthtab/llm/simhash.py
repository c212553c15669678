"""Near-duplicates by SimHash, compared bit-sliced.

Distinct fingerprints are keyed by the values of every two of five blocks of their bits: two
fingerprints within three differing bits agree on two blocks at least. Fingerprints with a
common key lie side by side in one sorted run; their bits are stored as 64 vertical planes,
and the run is compared with itself shifted by one, two, three places and so on. Differences of
all lanes are added at once by carry-save counters, a block of lanes is given up
as soon as all its lanes exceed the radius. Each run gives a spanning forest of its links;
connected components of the forests are found by alternating star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthtab.llm.common import pick, staged

SEED = 42
SHINGLE_WORDS = 3
BITS = 64
RADIUS = 3
# With RADIUS differing bits at most, AGREEING of these blocks are equal.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
AGREEING = len(BLOCKS) - RADIUS
# A key with more fingerprints is cut into parts of about this size; every two parts make a tile.
PART = 4096
# Lanes that are compared and given up together, in words of 64.
_LANE_BLOCK = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 18


def fingerprint(text: str) -> int:
    """SimHash of a text: the bits set in over half the hashes of its word shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    if len(words) > SHINGLE_WORDS:
        last = SHINGLE_WORDS - 1
        pairs = zip(starts[:-last].tolist(), stops[last:].tolist(), strict=True)
    else:
        pairs = [(0, len(line))]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in pairs], "<u8")
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        part = hashes[k : k + _CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """Columns ``_id`` and ``_fp`` (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter(
                (fingerprint(t.as_py() or "") for t in batch["_text"]), np.uint64, len(batch)
            )
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], pa.array(values.view(np.int64))], names=["_id", "_fp"]
            )

    rows = pick(docs, _id=id_column, _text=text_column)
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, _fp long")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Vertical storage: row ``b`` holds bit ``b`` of all values, 64 values in a word."""
    words = -(-len(values) // 64)
    padded = np.zeros(words * 64, "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")


def _pack(flags: np.ndarray) -> np.ndarray:
    words = -(-len(flags) // 64)
    padded = np.zeros(words * 64, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view("<u8")


def close_lanes(left: np.ndarray, right: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """Of the lanes set in ``lanes``, those whose planes differ in ``RADIUS`` bits at most.

    Differences are added with carry-save counters of two bits; a lane that passes three is
    out. Blocks of words without a lane left are not looked at again.
    """
    out = np.zeros_like(lanes)
    words = np.flatnonzero(lanes)
    if not len(words):
        return out
    alive = lanes[words]
    ones, twos = np.zeros_like(alive), np.zeros_like(alive)
    for bit in range(BITS):
        diff = left[bit, words] ^ right[bit, words]
        carry = ones & diff
        ones ^= diff
        over = twos & carry
        twos ^= carry
        alive &= ~over
        if bit % 8 == 7:
            keep = alive != 0
            if not keep.all():
                if not keep.any():
                    return out
                words, alive, ones, twos = words[keep], alive[keep], ones[keep], twos[keep]
    out[words] = alive
    return out


def _shifted(planes: np.ndarray, by: int, words: int) -> np.ndarray:
    """Planes whose lane ``i`` holds lane ``i + by``, for the first ``words`` words."""
    whole, part = divmod(by, 64)
    taken = np.zeros((len(planes), words + 1), "<u8")
    piece = planes[:, whole : whole + words + 1]
    taken[:, : piece.shape[1]] = piece
    if not part:
        return taken[:, :words]
    return (taken[:, :words] >> np.uint64(part)) | (taken[:, 1:] << np.uint64(64 - part))


class _Forest:
    """Union-find over positions in a run."""

    def __init__(self, size: int) -> None:
        self.parent = list(range(size))

    def root(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def links_in_run(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among values with equal keys; ``keys`` come in runs."""
    size = len(values)
    forest = _Forest(size)
    edges = np.flatnonzero(np.diff(keys)) + 1
    starts = np.concatenate([[0], edges])
    lengths = np.diff(np.append(starts, size))
    # Runs of one are done; those of like length are compared together, so that a long run
    # does not shift the short ones.
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 1]
    groups = np.array_split(order, np.flatnonzero(np.diff(np.log2(lengths[order]).astype(int))) + 1)
    for group in groups:
        if not len(group):
            continue
        reach = lengths[group]
        place = np.repeat(starts[group] - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach)
        place = place + np.arange(int(reach.sum()))
        left = np.repeat(reach, reach) - (place - np.repeat(starts[group], reach))
        mine = values[place]
        planes = bit_planes(mine)
        for shift in range(1, int(reach.max())):
            inside = left > shift
            last = int(np.flatnonzero(inside)[-1]) + 1
            words = -(-last // 64)
            near = close_lanes(
                planes[:, :words], _shifted(planes, shift, words), _pack(inside[:last])
            )
            if near.any():
                hit = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
                for k in hit.tolist():
                    forest.join(int(place[k]), int(place[k + shift]))
    roots = np.fromiter((forest.root(k) for k in range(size)), np.int64, size)
    linked = np.flatnonzero(roots != np.arange(size))
    return values[linked], values[roots[linked]]


def _keyed(distinct: DataFrame) -> DataFrame:
    """Fingerprints under each key: the chosen blocks' bits and the number of the choice."""
    choices = []
    for number, blocks in enumerate(combinations(BLOCKS, AGREEING)):
        key = " | ".join(
            f"shiftleft(shiftright(_fp, {at}) & {(1 << width) - 1}L, {sum(w for _, w in blocks[:k])})"
            for k, (at, width) in enumerate(blocks)
        )
        choices.append(f"struct({number} AS _choice, {key} AS _key)")
    return distinct.select("_fp", F.expr(f"inline(array({', '.join(choices)}))"))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) that connect all fingerprints of ``_fp`` within the radius.

    Every two linked fingerprints are connected by the links returned, though maybe over others.
    """
    keyed = _keyed(distinct)
    # Stored, so that adaptive execution can split a key with very many fingerprints in the join.
    counts = staged(
        keyed.groupBy("_choice", "_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "key_counts"
    )
    # Keys of one fingerprint go; a long key is cut into parts, every two of which meet in a tile.
    parts = F.expr(f"CAST((_n + {PART - 1}) div {PART} AS int)")
    tiled = (
        keyed.join(counts, ["_choice", "_key"])
        .withColumn("_parts", parts)
        .withColumn("_part", F.expr("CAST(pmod(xxhash64(_fp), _parts) AS int)"))
        .withColumn(
            "_tile",
            F.explode(
                F.expr(
                    "transform(sequence(0, _parts - 1), x -> struct(least(x, _part) AS i, greatest(x, _part) AS j))"
                )
            ),
        )
        .withColumn("_run", F.xxhash64("_choice", "_key", "_tile.i", "_tile.j"))
        .select("_run", "_fp")
    )
    runs = tiled.repartition("_run").sortWithinPartitions("_run", "_fp")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(keys: np.ndarray, values: np.ndarray) -> pd.DataFrame:
            a, b = links_in_run(keys, values.view(np.uint64))
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for frame in frames:
            keys = np.concatenate([held_keys, frame["_run"].to_numpy(np.int64)])
            values = np.concatenate([held, frame["_fp"].to_numpy(np.int64)])
            # The last run may go on in the next batch.
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            held_keys, held = keys[cut:], values[cut:]
            if cut:
                yield links(keys[:cut], values[:cut])
        if len(held):
            yield links(held_keys, held)

    found = runs.mapInPandas(compare, "a long, b long")
    return found.distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns ``node`` and ``root`` of all nodes on an edge (``a``, ``b`` as longs).

    Alternating large-star and small-star rounds; every round is written to the shared
    folder. A node's smallest neighbour comes from a partial aggregation, is stored and joined
    back, so that adaptive execution can split a node with very many neighbours. The root is the
    smallest node.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = staged(least, "least")
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        large = staged(large, "large_star")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = staged(small, "small_star")
        # Done when nothing is linked to a node that is itself linked to a smaller one.
        if after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            unsettled = after.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            if unsettled.isEmpty():
                break
        edges = after
    leaves = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(
        leaves.select(F.col("root").alias("node"), "root").distinct()
    )


def near_duplicates(docs: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """Fingerprint and component of every row: the identifier, ``fingerprint`` (signed long),
    ``component`` (smallest identifier reachable over links).

    Rows with equal fingerprints are linked, so copies of a text are counted once in the search. A
    null or blank text has the fingerprint zero and is linked like any other. Null
    identifiers get a component as well, but name none unless a component has no other; rows with
    equal identifiers stay rows of their own. Extra columns are not read. An empty table gives an empty
    result.
    """
    prints = staged(fingerprints(docs, id_column, text_column), "fingerprints")
    distinct = staged(prints.groupBy("_fp").agg(F.min("_id").alias("_least")), "distinct_fingerprints")
    roots = connected_components(fingerprint_links(distinct.select("_fp")))
    rooted = distinct.join(roots, distinct["_fp"] == roots["node"], "left").select(
        "_fp", "_least", F.coalesce("root", "_fp").alias("_root")
    )
    # Stored for the same reason: a fingerprint or a component may hold a third of all rows.
    components = staged(rooted.groupBy("_root").agg(F.min("_least").alias("component")), "components")
    of_print = staged(rooted.join(components, "_root").select("_fp", "component"), "of_print")
    return prints.join(of_print, "_fp").select(
        F.col("_id").alias(id_column), F.col("_fp").alias("fingerprint"), "component"
    )
