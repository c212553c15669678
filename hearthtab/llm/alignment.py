"""Alignment of two tokenizers by interval coalescing, with corpus-wide counts of linked id pairs.

The tokens of both tokenizers are byte intervals of the same text. All intervals of many texts, laid out
one after the other, are lexsorted by start; a group breaks where a start reaches the running maximum
(``maximum.accumulate``) of the ends. Inside a group the overlaps are expanded: between two neighbouring
starts lies exactly one pair of an A and a B token.

A pair's count is the number of texts that hold it linked. Texts are worked on in chunks; each chunk names
its distinct pairs once, so that pairs are shuffled per chunk and not per text. Counts come back to the
chunk, whose texts know their pairs by place. Neither the counts nor a chunk depend on the whole corpus in
one place: counts are joined by pair, chunks hold about ``CHUNK_BYTES`` of text or one text. Inside a chunk,
``SLICE_BYTES`` of text (or one text) are tokenized and aligned at a time, of which only the distinct pairs of
each text are kept.

A null or empty text, and a text whose joined token bytes differ from space + text (a normalising
vocabulary), has no tokens: zeros and an empty ``groups_sha256``. Rows repeated count as texts of their own.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hearthtab.llm.common import pick, staged

CHUNK_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
_SPACE = "▁".encode()
# Characters on whose classes all regular-expression engines agree.
_COMMON = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*").fullmatch
# What the byte-level tokenizer splits texts by (a fixed value of the vocabulary).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_symbol() -> dict[str, int]:
    """Printable character to the byte it stands for in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """Byte-level BPE of space + text. Entries are decoded to their bytes."""

    def __init__(self, file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(file)
        self._tokenizer.encode_special_tokens = True
        symbols = _byte_of_symbol()
        vocabulary = self._tokenizer.get_vocab()
        self.entries = [b""] * (max(vocabulary.values()) + 1)
        for entry, number in vocabulary.items():
            if all(c in symbols for c in entry):
                self.entries[number] = bytes(symbols[c] for c in entry)
        # The same vocabulary in a faster encoder, for texts of common characters.
        ranks = {entry: number for number, entry in enumerate(self.entries) if entry and number < len(self.entries) - 1}
        self._common = tiktoken.Encoding("common", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            if _COMMON(text):
                out.append(self._common.encode_ordinary(" " + text))
            else:
                out.append(self._tokenizer.encode(" " + text, add_special_tokens=False).ids)
        return out


class Pieces:
    """Sentence pieces of a text, which add the space themselves."""

    def __init__(self, file: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self._pieces = SentencePieceProcessor(model_file=file)
        self.size = self._pieces.get_piece_size()
        self.entries = []
        for number in range(self.size):
            piece = self._pieces.id_to_piece(number)
            if self._pieces.is_byte(number):
                self.entries.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.entries.append(piece.encode().replace(_SPACE, b" "))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._pieces.encode(texts, num_threads=1)


# One of each file per worker process: loading a vocabulary takes longer than a small task.
_LOADED: dict[tuple[str, str], Aligner] = {}


class Aligner:
    """Groups and links of texts."""

    def __init__(self, a_file: str, b_file: str) -> None:
        self.a, self.b = ByteLevel(a_file), Pieces(b_file)
        self._length = [np.array([len(e) for e in side.entries]) for side in (self.a, self.b)]
        # Decimal numbers in cells of eight bytes, followed by each of the marks.
        most = max(len(self.a.entries), len(self.b.entries))
        cells = [[f"{k}{mark}".encode().ljust(8, b"\0") for k in range(most)] for mark in (",", "|", ";", "")]
        self._cells = np.frombuffer(b"".join(map(b"".join, cells)), np.uint64).reshape(4, most)

    @staticmethod
    def loaded(a_file: str, b_file: str) -> Aligner:
        if (a_file, b_file) not in _LOADED:
            _LOADED[a_file, b_file] = Aligner(a_file, b_file)
        return _LOADED[a_file, b_file]

    def _tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where the bytes of either are not space + text."""
        both = []
        for side in (self.a, self.b):
            entry = side.entries.__getitem__
            ids = side.encode(texts)
            both.append([i if b"".join(map(entry, i)) == b" " + t.encode() else None for i, t in zip(ids, texts)])
        whole = [t != "" and a is not None and b is not None for t, a, b in zip(texts, *both)]
        return tuple([i if w else [] for i, w in zip(side, whole)] for side in both)

    def align(self, texts: list[str]) -> dict:
        """Per text: n_a, n_b, n_groups, n_links and ``groups`` (bytes); and all links in order of texts:
        ``link_text``, ``link_a``, ``link_b``.
        """
        n = len(texts)
        counts, ids, starts, ends = [], [], [], []
        for lists, length in zip(self._tokens(texts), self._length):
            counts.append(np.array([len(i) for i in lists], np.int64))
            ids.append(np.fromiter(chain.from_iterable(lists), np.int64, int(counts[-1].sum())))
            ends.append(np.cumsum(length[ids[-1]]))
            starts.append(ends[-1] - length[ids[-1]])
        n_a, n_b = len(ids[0]), len(ids[1])
        start, end = np.concatenate(starts), np.concatenate(ends)
        side = np.repeat(np.array([0, 1], np.int8), [n_a, n_b])
        order = np.lexsort((side, start))
        start, end, side = start[order], end[order], side[order]
        reach = np.maximum.accumulate(end)
        breaks = np.ones(len(start), bool)
        breaks[1:] = start[1:] >= reach[:-1]
        group = np.cumsum(breaks) - 1
        is_a = side == 0
        # Between two neighbouring starts lies one pair: the last A and the last B token begun.
        pair = np.ones(len(start), bool)
        pair[:-1] = start[1:] != start[:-1]
        a_at, b_at = (np.cumsum(is_a) - 1)[pair], (np.cumsum(~is_a) - 1)[pair]
        text_of_a = np.repeat(np.arange(n), counts[0])
        group_a, group_b = group[is_a], group[~is_a]
        n_groups = int(group[-1]) + 1 if len(group) else 0
        text_of_group = np.zeros(n_groups, np.int64)
        text_of_group[group_a] = text_of_a
        link_text = text_of_a[a_at]
        return {
            "n_a": counts[0],
            "n_b": counts[1],
            "n_groups": np.bincount(text_of_group, minlength=n),
            "n_links": np.bincount(link_text, minlength=n),
            "groups": self._written(ids, group_a, group_b, text_of_group, n),
            "link_text": link_text,
            "link_a": ids[0][a_at],
            "link_b": ids[1][b_at],
        }

    def _written(self, ids, group_a, group_b, text_of_group, n) -> list[memoryview]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        n_groups = len(text_of_group)
        per_group = [np.bincount(g, minlength=n_groups) for g in (group_a, group_b)]
        place = [
            np.arange(len(group_a)) + (np.cumsum(per_group[1]) - per_group[1])[group_a],
            np.arange(len(group_b)) + np.cumsum(per_group[0])[group_b],
        ]
        # The mark behind a token: a comma, the other side's bar, the next group's semicolon, or nothing.
        last_of_text = np.append(text_of_group[1:] != text_of_group[:-1], True) if n_groups else np.empty(0, bool)
        mark_a, mark_b = np.zeros(len(group_a), np.int8), np.zeros(len(group_b), np.int8)
        if n_groups:
            mark_a[np.cumsum(per_group[0]) - 1] = 1
            mark_b[np.cumsum(per_group[1]) - 1] = np.where(last_of_text, 3, 2)
        cells = np.empty(len(group_a) + len(group_b), np.uint64)
        text = np.empty(len(cells), np.int64)
        for at, mark, number, group in ((place[0], mark_a, ids[0], group_a), (place[1], mark_b, ids[1], group_b)):
            cells[at] = self._cells[mark, number]
            text[at] = text_of_group[group]
        written = cells.view(np.uint8).reshape(-1, 8)
        used = written != 0
        per_text = np.bincount(text, weights=used.sum(axis=1), minlength=n).astype(np.int64)
        flat = memoryview(np.ascontiguousarray(written[used]))
        bound = np.append(0, np.cumsum(per_text)).tolist()
        return [flat[a:b] for a, b in zip(bound, bound[1:])]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch in parts of bounded text, with their sizes."""
    sizes = np.array([len(t) for t in batch["text"].to_pylist()], np.int64)
    part = np.cumsum(sizes) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield int(sizes[a:b].sum()), batch.slice(a, b - a)


def _slices(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    view = memoryview(np.ascontiguousarray(values, np.uint32)).cast("B")
    edges = (4 * bounds).tolist()
    return pa.array([bytes(view[a:b]) for a, b in zip(edges, edges[1:])], pa.binary())


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


class _Chunk:
    """Aligned texts, each with its distinct pairs and how often it has them."""

    def __init__(self, aligner: Aligner, number: int, id_type: pa.DataType, with_groups: bool) -> None:
        self._aligner, self._number, self._id_type, self._with_groups = aligner, number, id_type, with_groups
        self._clear()

    def _clear(self) -> None:
        self.size = self.rows = 0
        self._ids: list[pa.Array] = []
        self._counts: list[list[np.ndarray]] = []
        self._digests: list[str] = []
        self._groups: list[str | None] = []
        self._pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, size: int, rows: pa.RecordBatch) -> None:
        found = self._aligner.align(rows["text"].to_pylist())
        n_b = len(self._aligner.b.entries)
        n_pairs = len(self._aligner.a.entries) * n_b
        key = np.sort(found["link_text"] * n_pairs + found["link_a"] * n_b + found["link_b"])
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
        text, pair = np.divmod(key[first], n_pairs)
        self._pairs.append((text + self.rows, pair, np.diff(np.append(first, len(key)))))
        self._ids.append(rows["id"])
        self._counts.append([found[c] for c in _COUNTS])
        self._digests += [hashlib.sha256(g).hexdigest() if len(g) else "" for g in found["groups"]]
        self._groups += [str(g, "ascii") if self._with_groups else None for g in found["groups"]]
        self.size += size
        self.rows += rows.num_rows

    def taken(self) -> Iterator[pa.RecordBatch]:
        """One row per text, with the places of its pairs in the chunk's list, and one row with that list."""
        self._number += 1
        n = self.rows
        text, pair, times = (np.concatenate(part) for part in zip(*self._pairs))
        pairs, place = np.unique(pair, return_inverse=True)
        bounds = np.searchsorted(text, np.arange(n + 1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([self._number] * n, pa.int64()), pa.concat_arrays(self._ids),
                *[pa.array(np.concatenate(c), pa.int64()) for c in zip(*self._counts)],
                pa.array(self._digests, pa.string()), pa.array(self._groups, pa.string()),
                _slices(place, bounds), _slices(times, bounds),
                pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64())),
            ],
            names=_ROW_NAMES,
        )
        texts = np.bincount(place, minlength=len(pairs))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([self._number], pa.int64()), pa.nulls(1, self._id_type), *[pa.nulls(1, pa.int64())] * 4,
                *[pa.nulls(1, pa.string())] * 2, *[pa.nulls(1, pa.binary())] * 2,
                pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(pairs, pa.int64())),
                pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(texts, pa.int64())),
            ],
            names=_ROW_NAMES,
        )
        self._clear()


def _align_rows(a_file: str, b_file: str, id_type: pa.DataType, with_groups: bool):
    """One row per text, with the places of its pairs in the chunk's list; one row per chunk with that list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.loaded(a_file, b_file)
        chunk = _Chunk(aligner, TaskContext.get().partitionId() << 33, id_type, with_groups)
        for batch in batches:
            for size, rows in _parts(batch):
                if chunk.size and chunk.size + size > CHUNK_BYTES:
                    yield from chunk.taken()
                chunk.add(size, rows)
        if chunk.rows:
            yield from chunk.taken()

    return run


_ROW_NAMES = ["chunk", "id", *_COUNTS, "groups_sha256", "groups", "places", "times", "pairs", "texts"]


def _sum_up(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """A chunk's texts and the counts of its pairs to the texts' sums."""
    order = np.argsort(pairs["place"].to_numpy())
    count = pairs["count"].to_numpy()[order]
    best = pairs["best"].to_numpy()[order].astype(np.int64)
    rows = rows.combine_chunks()
    n_best, count_sum = [], []
    for places, times in zip(rows["places"].to_pylist(), rows["times"].to_pylist()):
        place, time = np.frombuffer(places, np.uint32), np.frombuffer(times, np.uint32).astype(np.int64)
        n_best.append(int((best[place] * time).sum()))
        count_sum.append(int((count[place] * time).sum()))
    return rows.select(["id", *_COUNTS, "groups_sha256", "groups"]).append_column(
        "n_best", pa.array(n_best, pa.int64())
    ).append_column("count_sum", pa.array(count_sum, pa.int64()))


def align_tokenizers(
    docs: DataFrame,
    a_file: str,
    b_file: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_groups: bool = False,
) -> DataFrame:
    """Per row: identifier, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and ``groups``
    (text, null unless ``with_groups``).

    ``a_file`` is a byte-level vocabulary of ``tokenizers``, ``b_file`` a model of ``sentencepiece``.
    """
    held = pick(docs, id=id_column, text=text_column).withColumn("text", F.coalesce("text", F.lit("")))
    id_field = T.StructField("id", held.schema["id"].dataType)
    fields = {f: T.LongType() for f in _COUNTS} | {"groups_sha256": T.StringType(), "groups": T.StringType()}
    known = [T.StructField(n, t) for n, t in fields.items()]
    lists = T.ArrayType(T.LongType())
    aligned = T.StructType(
        [
            T.StructField("chunk", T.LongType()), id_field, *known,
            *[T.StructField(n, T.BinaryType()) for n in ("places", "times")],
            *[T.StructField(n, lists) for n in ("pairs", "texts")],
        ]
    )
    n_b = Pieces(b_file).size
    id_type = to_arrow_type(id_field.dataType)
    rows = staged(held.mapInArrow(_align_rows(a_file, b_file, id_type, with_groups), aligned), "aligned")
    of_chunk = rows.where("pairs is not null").select(
        "chunk", F.posexplode(F.arrays_zip("pairs", "texts")).alias("place", "pair")
    )
    listed = of_chunk.select("chunk", "place", F.col("pair.pairs").alias("pair"), F.col("pair.texts").alias("texts"))
    counts = staged(listed.groupBy("pair").agg(F.sum("texts").alias("count")), "pair_counts")
    # At most as many rows as the A side has ids.
    best = counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("count").alias("most"))
    judged = counts.join(best, F.expr(f"pair div {n_b}") == F.col("a")).select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best")
    )
    answers = listed.select("chunk", "place", "pair").join(judged, "pair").select(
        F.col("chunk").alias("of_chunk"), "place", "count", "best"
    )
    summed = (
        rows.where("pairs is null")
        .drop("pairs", "texts")
        .groupBy("chunk")
        .cogroup(answers.groupBy("of_chunk"))
        .applyInArrow(
            _sum_up,
            T.StructType([id_field, *known, *[T.StructField(n, T.LongType()) for n in ("n_best", "count_sum")]]),
        )
    )
    return summed.select(
        F.col("id").alias(id_column), *_COUNTS, "n_best", "count_sum", "groups_sha256", "groups"
    )
