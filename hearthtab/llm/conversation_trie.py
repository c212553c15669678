"""Prefix trie of conversations by the Euler-tour technique.

A conversation is a sequence of turns (role, text). Each distinct sequence of first turns is a node; its
members are the conversations that start with it. Figures of whole subtrees come from an Euler tour:
every node has an enter and an exit arc, each arc knows the next one, the list of arcs is ranked, and
sums over the arcs between enter and exit are sums over the subtree.

* **Prefixes** are named by their length and two running 64-bit exclusive-ors of hashes of place, role and
  text. The text itself is shuffled once, to order the turns.
* **Running values** of an ordinary conversation, or place among its siblings, come from a window. Those of
  a conversation or parent with more than ``rows_per_task`` rows come from range partitions, whose totals
  are added up.
* **List ranking**: stretches of the tour that lie in one range of arcs are contracted where they are; arcs
  are numbered along the conversations, so that few stretches remain. While the contracted list is longer
  than ``SHORT_LIST``, it is contracted further, by ranges and by splicing every arc with coin 1 into a
  predecessor with coin 0. The short list is ranked in one task and every contraction undone by a join.

Turns are ordered by turn (null first), then role, then text; null role and text are empty. Rows without a
conversation belong to none and are left out. Repeated rows are turns of their own. An empty table has no
conversation and no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthtab.llm.common import id_crc32, pick, staged
from hearthtab.operators.skew import DEFAULT_LIMITS, SkewLimits, find_heavy

GROUP = 5
MOST_BORROWED = 8
ARCS_PER_TASK = 1 << 18
SHORT_LIST = 100_000

_NODE = ["depth", "p1", "p2"]


def _combine(kind: str, one: Column, two: Column) -> Column:
    return one + two if kind == "sum" else one.bitwiseXOR(two)


def running(
    rows: DataFrame,
    segment: Sequence[str],
    order: Sequence[str],
    values: dict[str, tuple[str, Column]],
    limits: SkewLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Stored rows with running values of each segment, the row itself included.

    ``values``: name to (``sum`` or ``xor``, column). ``segment`` holds no nulls. Heavy segments are cut
    into ranges by order; each range adds the totals of earlier ranges.
    """
    aggregate = {"sum": F.sum, "xor": F.bit_xor}
    columns = rows.columns
    by_order = [F.col(c).asc_nulls_first() for c in order]
    heavy = find_heavy(rows, segment, limits)
    upto = (Window.unboundedPreceding, Window.currentRow)
    inside = Window.partitionBy(*segment).orderBy(*by_order).rowsBetween(*upto)
    plain = rows
    if heavy.table is not None:
        plain = rows.join(heavy.table.select(*segment), list(segment), "left_anti")
    done = plain.select(*columns, *[aggregate[k](v).over(inside).alias(n) for n, (k, v) in values.items()])
    if heavy.table is None:
        return done
    many = rows.join(heavy.table.select(*segment), list(segment), "left_semi")
    tasks = -(-heavy.table.agg(F.sum("rows")).first()[0] // heavy.rows_per_task) + 1
    by = [*[F.col(c) for c in segment], *by_order, F.col("_any")]
    placed = staged(
        many.select(*columns, *[v.alias(n) for n, (_, v) in values.items()])
        .withColumn("_any", F.monotonically_increasing_id())
        .repartitionByRange(tasks, *by)
        .sortWithinPartitions(*by)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id()),
        "running",
    )
    within = Window.partitionBy("_part", *segment).orderBy("_place").rowsBetween(*upto)
    earlier = (
        Window.partitionBy(*segment).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per segment and range.
    carry = placed.groupBy("_part", *segment).agg(*[aggregate[k](n).alias(n) for n, (k, _) in values.items()])
    carry = carry.select(
        "_part", *segment,
        *[F.coalesce(aggregate[k](n).over(earlier), F.lit(0)).alias(f"_{n}") for n, (k, _) in values.items()],
    )
    own = placed.select("_part", *columns, *[aggregate[k](n).over(within).alias(n) for n, (k, _) in values.items()])
    summed = own.join(carry, ["_part", *segment]).select(
        *columns, *[_combine(k, F.col(n), F.col(f"_{n}")).alias(n) for n, (k, _) in values.items()]
    )
    return done.unionByName(summed)


def rebuilt_turns(conversations: DataFrame, limits: SkewLimits = DEFAULT_LIMITS) -> DataFrame:
    """Turns of every rebuilt conversation: conv, place (from 1), two hashes of role and text, n_bytes.

    Conversation c takes the first h turns of conversation c - c mod 5 in place of its own first h ones,
    h being the checksum of c's decimal text mod 9.
    """
    held = pick(conversations, conv="conv_id", turn="turn", role="role", text="text").where("conv is not null")
    held = held.select(
        F.col("conv").cast("long").alias("conv"),
        "turn",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")],
    )
    one = F.lit(1).cast("long")
    numbered = running(held, ["conv"], ["turn", "role", "text"], {"at": ("sum", one)}, limits).select(
        "conv", "at",
        F.xxhash64("role", F.lit(0), "text").alias("h1"),
        F.xxhash64(F.lit(1), "text", F.lit(2), "role").alias("h2"),
        F.octet_length("text").cast("long").alias("n_bytes"),
    )
    turns = staged(numbered, "turns")
    h = id_crc32(F.col("conv")) % 9
    base = F.col("conv") - F.pmod(F.col("conv"), F.lit(GROUP))
    convs = turns.select("conv").distinct().select("conv", h.alias("h"), base.alias("base")).where("conv <> base")
    heads = turns.where(F.col("at") <= MOST_BORROWED).withColumnRenamed("conv", "base")
    borrowed = convs.join(heads, "base").where("at <= h").select(turns.columns)
    # Own turns stand behind all borrowed ones; places are counted anew.
    own = turns.where((F.col("conv") == base) | (F.col("at") > h)).withColumn("at", F.col("at") + MOST_BORROWED)
    both = staged(borrowed.unionByName(own), "rebuilt")
    return running(both, ["conv"], ["at"], {"depth": ("sum", one)}, limits)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conversation) to one checksum per node; a node may go over many batches."""
    last, digest = None, None

    def out(node, digest):
        columns = [pa.array([v], pa.int64()) for v in node] + [pa.array([digest.hexdigest()])]
        return pa.RecordBatch.from_arrays(columns, names=[*_NODE, "ends_sha256"])

    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = np.stack([np.asarray(batch[c]) for c in _NODE])
        new = np.flatnonzero(np.append(True, (nodes[:, 1:] != nodes[:, :-1]).any(axis=0)))
        convs = batch["conv"].to_pylist()
        for a, b in zip(new, [*new[1:], len(convs)]):
            node, text = tuple(nodes[:, a].tolist()), ",".join(map(str, convs[a:b])).encode()
            if node == last:
                digest.update(b"," + text)
            else:
                if last is not None:
                    yield out(last, digest)
                last, digest = node, hashlib.sha256(text)
    if last is not None:
        yield out(last, digest)


_SUMS = ["leaf", "saved"]
_LIST = "arc long, next long, leaf long, saved long"
_CHAINS = "arc long, head long, tail boolean, next long, leaf long, saved long, before_leaf long, before_saved long"


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arcs of one task to the stretches they form: each arc's head and the sums before it."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    table = table.combine_chunks().sort_by("arc")
    arc, leaf, saved = (table[c].to_numpy() for c in ("arc", "leaf", "saved"))
    n = len(arc)
    # The end of the list has no next arc.
    following = table["next"].fill_null(-1).to_numpy()
    place = np.minimum(np.searchsorted(arc, following), n - 1)
    inside = arc[place] == following
    back = np.arange(n)
    back[place[inside]] = np.flatnonzero(inside)
    # Pointer jumping inside the task. A head points to itself and adds nothing.
    at_head = back == np.arange(n)
    sums = [np.where(at_head, 0, v[back]) for v in (leaf, saved)]
    while True:
        further = back[back]
        if (further == back).all():
            break
        sums = [s + s[back] for s in sums]
        back = further
    yield from pa.table(
        {
            "arc": arc, "head": arc[back], "tail": ~inside, "next": table["next"], "leaf": leaf, "saved": saved,
            "before_leaf": sums[0], "before_saved": sums[1],
        }
    ).combine_chunks().to_batches()


def _contract_ranges(arcs: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """The list of stretches, and each arc's stretch."""
    dealt = arcs.repartitionByRange(tasks, "arc") if tasks > 1 else arcs.coalesce(1)
    chains = staged(dealt.mapInArrow(_chains, _CHAINS), "tour_ranges")
    # The last arc of a stretch knows the sums of all of it.
    shorter = chains.where("tail").select(
        F.col("head").alias("arc"), "next", *[(F.col(c) + F.col(f"before_{c}")).alias(c) for c in _SUMS]
    )
    return shorter, chains.select("arc", "head", *[f"before_{c}" for c in _SUMS])


def _contract_pairs(arcs: DataFrame, round_: int) -> tuple[DataFrame, DataFrame]:
    """Arcs with coin 1 joined to a predecessor with coin 0: three quarters remain on average."""
    coin = F.pmod(F.xxhash64("arc", F.lit(round_)), F.lit(2))
    tossed = arcs.withColumn("coin", coin)
    joined = tossed.where("coin = 1").select(
        F.col("arc").alias("next"), F.col("next").alias("beyond"), *[F.col(c).alias(f"more_{c}") for c in _SUMS],
        F.lit(True).alias("taken"),
    )
    pairs = staged(tossed.where("coin = 0").join(joined, "next", "left"), "tour_pairs")
    taken = pairs.where("taken")
    grown = pairs.select(
        "arc",
        F.when(F.col("taken"), F.col("beyond")).otherwise(F.col("next")).alias("next"),
        *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in _SUMS],
    )
    gone = taken.select(F.col("next").alias("arc"))
    alone = arcs.where(coin == 1).join(gone, "arc", "left_anti")
    shorter = grown.unionByName(alone.select(grown.columns))
    zero = [F.lit(0).cast("long").alias(f"before_{c}") for c in _SUMS]
    own = shorter.select("arc", F.col("arc").alias("head"), *zero)
    spliced = taken.select(
        F.col("next").alias("arc"), F.col("arc").alias("head"), *[F.col(c).alias(f"before_{c}") for c in _SUMS]
    )
    return shorter, own.unionByName(spliced)


def rank_tour(
    arcs: DataFrame, arcs_per_task: int = ARCS_PER_TASK, short_list: int = SHORT_LIST
) -> DataFrame:
    """Sums of ``leaf`` and ``saved`` over all arcs before each arc of a linked list (arc, next)."""
    steps: list[DataFrame] = []
    rows, round_ = arcs.count(), 0
    while rows > short_list:
        arcs, step = _contract_ranges(arcs, -(-rows // arcs_per_task) + 1)
        steps.append(step)
        arcs, rows = (arcs := staged(arcs, "tour")), arcs.count()
        if rows > short_list:
            arcs, step = _contract_pairs(arcs, round_)
            steps.append(step)
            arcs, rows = (arcs := staged(arcs, "tour")), arcs.count()
        round_ += 1
    # At most ``short_list`` stretches are left, which one task ranks.
    ranked = _contract_ranges(arcs, 1)[1].select("arc", *[f"before_{c}" for c in _SUMS])
    for step in reversed(steps):
        heads = ranked.select(F.col("arc").alias("head"), *[F.col(f"before_{c}").alias(f"h_{c}") for c in _SUMS])
        ranked = step.join(heads, "head").select(
            "arc", *[(F.col(f"before_{c}") + F.col(f"h_{c}")).alias(f"before_{c}") for c in _SUMS]
        )
    return ranked


def build_trie(
    turns: DataFrame,
    convs: DataFrame,
    limits: SkewLimits = DEFAULT_LIMITS,
    arcs_per_task: int = ARCS_PER_TASK,
    short_list: int = SHORT_LIST,
) -> DataFrame:
    """Nodes of the trie over ``turns`` (conv, depth, h1, h2, n_bytes) of all conversations ``convs`` (conv).

    Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    tagged = staged(
        turns.select(
            "conv", "depth", "n_bytes",
            F.xxhash64("depth", "h1", "h2").alias("g1"), F.xxhash64("h2", F.lit(3), "h1", "depth").alias("g2"),
        ),
        "trie_turns",
    )
    prefixed = running(
        tagged, ["conv"], ["depth"], {"p1": ("xor", F.col("g1")), "p2": ("xor", F.col("g2"))}, limits
    )
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    members = staged(
        prefixed.select(
            "conv", *_NODE, "n_bytes",
            F.col("p1").bitwiseXOR(F.col("g1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("g2")).alias("q2"),
        ).unionByName(
            convs.select(
                "conv", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("n_bytes"),
                none.alias("q1"), none.alias("q2"),
            )
        ),
        "trie_members",
    )
    merged = members.groupBy(*_NODE).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        *[F.max(c).alias(c) for c in ("n_bytes", "q1", "q2")],
    )
    # Numbered along the conversations: a node's chain of only children has numbers in a row.
    nodes = staged(
        merged.repartitionByRange("conv_id", "depth", "p1")
        .sortWithinPartitions("conv_id", "depth", "p1")
        .withColumn("node", F.monotonically_increasing_id()),
        "trie_nodes",
    )
    parents = nodes.select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"),
        F.col("p1").alias("q1"), F.col("p2").alias("q2"),
    )
    linked = staged(
        nodes.where("depth > 0").select("node", "conv_id", "depth", "q1", "q2").join(parents, ["depth", "q1", "q2"])
        .select("node", "conv_id", "parent", "parent_conv_id"),
        "trie_links",
    )
    one = F.lit(1).cast("long")
    children = staged(
        running(linked, ["parent"], ["conv_id", "node"], {"place": ("sum", one)}, limits), "trie_children"
    )
    below = children.groupBy("parent").agg(
        F.count(F.lit(1)).alias("n_children"), F.min(F.when(F.col("place") == 1, F.col("node"))).alias("first")
    )
    siblings = children.select("parent", (F.col("place") - 1).alias("place"), F.col("node").alias("sibling"))
    beside = children.join(siblings, ["parent", "place"], "left").select("node", "parent", "parent_conv_id", "sibling")
    whole = staged(
        nodes.drop("q1", "q2")
        .join(below.withColumnRenamed("parent", "node"), "node", "left")
        .join(beside, "node", "left"),
        "trie_whole",
    )
    enter, exit_ = F.col("node") * 2, F.col("node") * 2 + 1
    arcs = whole.select(
        enter.alias("arc"),
        F.coalesce(F.col("first") * 2, exit_).alias("next"),
        F.col("n_children").isNull().cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
    ).unionByName(
        whole.select(
            exit_.alias("arc"),
            F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"),
            zero.alias("leaf"),
            zero.alias("saved"),
        )
    )
    ranked = rank_tour(staged(arcs, "tour"), arcs_per_task, short_list)
    is_exit = F.col("arc") % 2 == 1
    subtree = ranked.groupBy(F.shiftright("arc", 1).alias("node")).agg(
        *[
            (F.max(F.when(is_exit, F.col(f"before_{c}"))) - F.max(F.when(~is_exit, F.col(f"before_{c}")))).alias(n)
            for c, n in (("leaf", "n_leaves"), ("saved", "saved_tokens"))
        ]
    )
    last = members.groupBy("conv").agg(F.max_by(F.struct(*_NODE), "depth").alias("end"))
    ends = (
        last.select(*[F.col(f"end.{c}").alias(c) for c in _NODE], "conv")
        .repartition(*_NODE)
        .sortWithinPartitions(*_NODE, "conv")
        .mapInArrow(_ends, "depth long, p1 long, p2 long, ends_sha256 string")
    )
    return (
        whole.join(subtree, "node")
        .join(ends, _NODE, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs",
            F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def prefix_trie(conversations: DataFrame, limits: SkewLimits = DEFAULT_LIMITS, **sizes: int) -> DataFrame:
    """:func:`build_trie` over the rebuilt conversations."""
    convs = pick(conversations, conv="conv_id").where("conv is not null")
    convs = convs.select(F.col("conv").cast("long").alias("conv")).distinct()
    return build_trie(rebuilt_turns(conversations, limits), convs, limits, **sizes)
