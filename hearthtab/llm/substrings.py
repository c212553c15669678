"""Removal of repeated substrings by external suffix sorting.

A byte goes if it lies in a string of ``least`` bytes that also starts earlier: in a row of smaller
identifier (null first, then by a hash of the text), or further left in the same text. Strings are judged
on the input, and matches never cross rows.

1. Every window of ``least`` bytes belongs to the place of its smallest 32-byte hash. Equal windows have
   equal places, so a *piece* of text, the windows of one place, meets all pieces that can repeat it under
   the place's hash. Only hashes and positions are shuffled.
2. Of pieces equal as a whole all but the first repeat. A piece alone under its hash repeats nothing.
3. The rest goes to shards by hash, in input order. Each shard is suffix-sorted
   (:mod:`hearthtab.llm.induced_sort`); suffixes sharing ``least`` bytes with their neighbour form a
   class, of which all but the first position repeat. Texts without such pieces are settled before that
   and not stored; the others wait, laid out by row, for what the shards find.

Hot hashes (a line in a third of all rows) are found on one row in 64; their pieces are cut into single
windows, each dealt by the hash of all its bytes, so that no shard gets them all. Copies of a piece are
set aside before the shuffle, so that a text repeated any number of times sends one row per batch.

A null text is empty. Rows repeated with identifier and text count as later than their first one. The
result has one row per row of the table, extra columns are not used. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthtab.llm import induced_sort
from hearthtab.llm.common import pick, staged_by

LEAST = 100
GRAM = 32
SHARD_BYTES = 4 << 20
# A hash is hot if so many pieces of one row in 64 have it; at most so many hashes are hot.
SAMPLE_OF = 64
HOT_IN_SAMPLE = 200
MOST_HOT = 10_000

_STRETCH = 1 << 20
_PLACE = np.uint64(_STRETCH - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = 0xD6E8FEB86659FD93


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _powers(factor: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n, factor, np.uint64)), dtype=np.uint64)


class _Cutter:
    """Cuts texts into pieces. One per Python worker: it holds tables of powers."""

    def __init__(self, least: int) -> None:
        self.least = least
        # A stretch has no more than one million places, as places are kept in 20 bits.
        self._up = _powers(_FACTOR, _STRETCH)
        self._down = _powers(pow(_FACTOR, -1, 1 << 64), _STRETCH)

    def _grams(self, values: np.ndarray) -> np.ndarray:
        """Hash of the 32 bytes from each position on."""
        h, size = values, 1
        while size < GRAM:
            h = h[:-size] * self._up[size] + h[size:]
            size *= 2
        return _mixed(h)

    def cut(self, joined: np.ndarray, part_of: np.ndarray):
        """Pieces of a stretch of joined texts: key, content, first position, number of windows."""
        least = self.least
        n = len(joined) - least + 1
        if n <= 0:
            return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
        values = _mixed((joined.astype(np.uint64) + np.uint64(1)) * _MIX)
        grams = self._grams(values)
        smallest = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        width, size = least - GRAM + 1, 1
        while 2 * size <= width:
            smallest = np.minimum(smallest[:-size], smallest[size:])
            size *= 2
        smallest = np.minimum(smallest[:n], smallest[width - size : width - size + n])
        place = (smallest & _PLACE).astype(np.int64)
        inside = part_of[:n] == part_of[least - 1 :]
        change = np.append(
            True,
            (place[1:] != place[:-1]) | (inside[1:] != inside[:-1]) | (part_of[1:n] != part_of[: n - 1]),
        )
        start = np.flatnonzero(change)
        windows = np.diff(np.append(start, n))
        kept = inside[start]
        start, windows = start[kept], windows[kept]
        key = _mixed(grams[place[start]])
        self._sums = np.append(np.uint64(0), np.cumsum(values * self._down[: len(values)], dtype=np.uint64))
        return key, self.content(start, windows), start, windows

    def content(self, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Hash of the pieces' bytes in the stretch that was cut last."""
        end = start + windows + self.least - 1
        h = (self._sums[end] - self._sums[start]) * self._up[start]
        return _mixed(_mixed(h) + windows.astype(np.uint64))


def _stretches(texts: list[bytes], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Joined parts of texts, at most one stretch: bytes, part of each byte, row and place of each part.

    Longer texts are cut into parts that share all but one byte of a window.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        rows, places, parts = zip(*held)
        lengths = np.array([len(part) for part in parts])
        return (
            np.frombuffer(b"".join(parts), np.uint8),
            np.repeat(np.arange(len(parts)), lengths),
            np.array(rows),
            np.array(places) - np.cumsum(lengths) + lengths,
        )

    for row, text in enumerate(texts):
        at = 0
        while len(text) - at >= least:
            part = text[at : at + _STRETCH // 2]
            if size + len(part) > _STRETCH:
                yield joined()
                held, size = [], 0
            held.append((row, at, part))
            size += len(part)
            at += len(part) - least + 1
    if held:
        yield joined()


def _pieces(texts: list[bytes], cutter: _Cutter, hot: np.ndarray):
    """Key, content, row, start and windows of all pieces of a batch."""
    found = []
    for joined, part_of, row_of, place in _stretches(texts, cutter.least):
        key, content, start, windows = cutter.cut(joined, part_of)
        if len(hot):
            is_hot = np.isin(key, hot)
            if is_hot.any():
                each = windows[is_hot]
                single = np.repeat(start[is_hot] - np.cumsum(each) + each, each) + np.arange(each.sum())
                ones = np.ones(len(single), np.int64)
                own = cutter.content(single, ones)
                key, content = np.append(key[~is_hot], _mixed(own)), np.append(content[~is_hot], own)
                start, windows = np.append(start[~is_hot], single), np.append(windows[~is_hot], ones)
        part = part_of[start]
        found.append((key, content, row_of[part], place[part] + start, windows))
    if not found:
        return None
    return tuple(np.concatenate(part) for part in zip(*found))


def _binary(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return pc.cast(column, pa.large_binary()).to_pylist()


# A mark is a first position and a number of windows: start * 256 + windows.
_WINDOWS = 8


def _cut_rows(least: int, hot: np.ndarray):
    """Rows to pieces. Copies of a piece inside a batch lose their content and are dealt anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(least)
        for batch in batches:
            parts = _pieces(_binary(batch["text"]), cutter, hot)
            if parts is None:
                continue
            key, content, row, start, windows = parts
            content = content.astype(np.uint32)
            ids, hashes = batch["id"].to_pylist(), np.asarray(batch["row"])
            # Equal rows have equal ranks, so that copies of a place follow each other.
            distinct = sorted(set(zip((i is not None for i in ids), ids, hashes.tolist())))
            rank_of = {(i, h): k for k, (_, i, h) in enumerate(distinct)}
            ranks = np.array([rank_of[i, h] for i, h in zip(ids, hashes.tolist())])
            order = np.lexsort((start, ranks[row], content, key))
            key, content, row, start, windows = (p[order] for p in (key, content, row, start, windows))
            copy = np.append(False, (key[1:] == key[:-1]) & (content[1:] == content[:-1]))
            # A row that is repeated as a whole is no copy of itself.
            rank = ranks[row]
            itself = np.append(False, copy[1:] & (rank[1:] == rank[:-1]) & (start[1:] == start[:-1]))
            key[copy] = _mixed(start[copy].astype(np.uint64) + hashes[row[copy]].view(np.uint64))
            # In input order, in which neighbours share their row: that packs better.
            kept = np.flatnonzero(~itself)
            kept = kept[np.lexsort((start[kept], row[kept]))]
            row = row[kept]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].take(pa.array(row)),
                    pa.array(hashes[row]),
                    pa.array(key[kept].view(np.int64)),
                    pa.array(content[kept].view(np.int32), mask=copy[kept]),
                    pa.array((start[kept] << _WINDOWS) + windows[kept]),
                ],
                names=["id", "row", "key", "content", "mark"],
            )

    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to whole repeats (no key) and pieces to be sorted (key); others are left out.

    The last key's first piece is held back until another piece of that key is seen.
    """
    names = ["id", "row", "mark", "key"]
    held: pa.RecordBatch | None = None
    several_held = False
    for batch in batches:
        copy = pc.is_null(batch["content"])
        if pc.any(copy).as_py():
            sure = batch.filter(copy)
            yield pa.RecordBatch.from_arrays(
                [*(sure[c] for c in names[:3]), pa.nulls(sure.num_rows, pa.int64())], names
            )
            batch = batch.filter(pc.invert(copy))
        if not batch.num_rows:
            continue
        had = held is not None
        if had:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key, content, row, mark = (np.asarray(batch[c]) for c in ("key", "content", "row", "mark"))
        new_key = np.append(True, key[1:] != key[:-1])
        new = new_key.copy()
        new[1:] |= content[1:] != content[:-1]
        # Identifiers are part of a row's hash, which is enough to tell neighbours apart.
        itself = np.append(False, (row[1:] == row[:-1]) & (mark[1:] == mark[:-1]))
        repeat = ~new & ~itself
        group = np.cumsum(new_key) - 1
        several = np.bincount(group[new], minlength=group[-1] + 1) > 1
        out = repeat | (new & several[group])
        if had and several_held:
            # The held row is out already, and so is its key's first piece.
            out = repeat | (new & (several[group] | (group == 0)))
            out[0] = False
            several[0] = True
        if out.any():
            rows = batch.filter(pa.array(out))
            yield pa.RecordBatch.from_arrays(
                [*(rows[c] for c in names[:3]), pa.array(key[out], mask=repeat[out])], names
            )
        several_held = bool(several[-1])
        last = len(key) - 1 if several_held else int(np.flatnonzero(new)[-1])
        held = batch.slice(last, 1)


def _flat(marks: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row of each mark, marks and keys of a column of lists."""
    place = np.repeat(np.arange(len(marks)), np.asarray(pc.list_value_length(marks)))
    values = marks.flatten()
    return place, np.asarray(values.field("mark")), values.field("key")


def _cut_marked(least: int):
    """Texts with marks to the bytes of the pieces that go to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _binary(batch["text"])
            place, mark, key = _flat(batch["marks"])
            chosen = np.flatnonzero(np.asarray(key.is_valid()))
            place, mark = place[chosen], mark[chosen]
            start, end = mark >> _WINDOWS, (mark >> _WINDOWS) + (mark & 255) + least - 1
            pieces = [texts[k][a:b] for k, a, b in zip(place.tolist(), start.tolist(), end.tolist())]
            rows = batch.select(["id", "id_hash", "row"]).take(pa.array(place))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, key.take(pa.array(chosen)), pa.array(start), pa.array(pieces, pa.binary())],
                names=["id", "id_hash", "row", "key", "start", "piece"],
            )

    return run


def _sort_shard(least: int):
    """All pieces of a shard, in input order, to their windows that occur further up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[np.ndarray]] = []
        texts: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                pieces = batch["piece"].to_pylist()
                windows = np.array([len(piece) - least + 1 for piece in pieces])
                rows.append([*(np.asarray(batch[c]) for c in ("id_hash", "row", "start")), windows])
                # Bytes of UTF-8 are below 245: 0 ends the shard, 1 ends a piece.
                joined = np.frombuffer(b"\xfe".join(pieces) + b"\xfe", np.uint8)
                texts.append(np.where(joined == 0xFE, 1, joined + 2).astype(np.uint8))
        if not rows:
            return
        id_hash, row, start, windows = (np.concatenate(part) for part in zip(*rows))
        text = induced_sort.scratch(sum(map(len, texts)) + 1, np.uint8)
        at = 0
        while texts:
            part = texts.pop(0)
            text[at : at + len(part)] = part
            at += len(part)
        text[at] = 0
        first = np.cumsum(windows + least) - windows - least
        order, shared = induced_sort.suffixes_with_prefixes(text, 256, least)
        # Positions with a whole window; others share nothing of that length with them.
        whole = np.zeros(len(text) + 1, np.int8)
        whole[first] += 1
        whole[first + windows] -= 1
        whole = np.cumsum(whole, dtype=np.int8).astype(bool)
        group = np.cumsum(shared < least, dtype=np.int64)
        chosen = whole[order]
        order, group = order[chosen], group[chosen]
        begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        earliest = np.minimum.reduceat(order, begins)
        later = np.ones(len(text), bool)
        later[earliest] = False
        later &= whole[: len(text)]
        edges = np.diff(np.concatenate(([0], later.astype(np.int8), [0])))
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        owner = np.searchsorted(first, begin, side="right") - 1
        if len(begin):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(id_hash[owner]), pa.array(row[owner]),
                    pa.array(((start[owner] + begin - first[owner]) << _WINDOWS) + end - begin),
                ],
                names=["id_hash", "row", "mark"],
            )

    return run


def _merged(place: np.ndarray, mark: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the maximal spans that marks of rows cover."""
    order = np.lexsort((mark, place))
    place, begin = place[order], mark[order] >> _WINDOWS
    end = begin + (mark[order] & 255) + least - 1
    if not len(end):
        return place, begin, end
    # Rows are laid out one after the other: a span begins where nothing before reaches.
    apart = place * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + apart)
    first = np.flatnonzero(np.append(True, begin[1:] + apart[1:] > reach[:-1]))
    last = np.append(first[1:], len(end)) - 1
    return place[first], begin[first], reach[last] - apart[last]


_LEFT = "spans array<struct<start: long, end: long>>, n_removed long, kept_sha256 string, kept binary"


def _settle(least: int, with_text: bool):
    """Texts with marks: what is left where nothing has to be sorted; else the text and its marks."""
    remove = _remove(least, with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, _, key = _flat(batch["marks"])
            waits = np.zeros(batch.num_rows, bool)
            waits[place[np.asarray(key.is_valid())]] = True
            later, now = batch.filter(pa.array(waits)), batch.filter(pa.array(~waits))
            names = [*batch.schema.names, "spans", "n_removed", "kept_sha256", "kept"]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            if later.num_rows:
                empty = [pa.nulls(later.num_rows, t) for t in (span, pa.int64(), pa.string(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*later.columns, *empty], names)
            if now.num_rows:
                none = pa.nulls(now.num_rows, pa.list_(pa.int64()))
                (left,) = remove(iter([now.append_column("more", none)]))
                out = {c: now[c] for c in ("id", "id_hash", "row")} | {
                    c: left[c] for c in ("spans", "n_removed", "kept_sha256", "kept")
                }
                columns = [out.get(n, pa.nulls(now.num_rows, batch.schema.field(n).type) if n in ("text", "marks") else None) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _remove(least: int, with_text: bool):
    """Texts with marks to what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _binary(batch["text"])
            place, mark, key = _flat(batch["marks"])
            sure = np.asarray(key.is_null())
            more = batch["more"]
            extra = np.repeat(np.arange(len(more)), np.asarray(pc.fill_null(pc.list_value_length(more), 0)))
            place, mark = np.append(place[sure], extra), np.append(mark[sure], np.asarray(more.flatten()))
            owner, begin, end = _merged(place, mark, least)
            offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=len(texts))))
            sizes = np.append(0, np.cumsum(end - begin))
            digests, kept_texts = [], []
            for k, text in enumerate(texts):
                mine = slice(offsets[k], offsets[k + 1])
                cuts = zip([0, *end[mine].tolist()], [*begin[mine].tolist(), len(text)])
                kept = b"".join([text[a:b] for a, b in cuts])
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept if with_text else None)
            spans = pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], ["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id_hash"], batch["row"],
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans),
                    pa.array(np.diff(sizes[offsets])), pa.array(digests, pa.string()),
                    pa.array(kept_texts, pa.binary()),
                ],
                names=["id_hash", "row", "spans", "n_removed", "kept_sha256", "kept"],
            )

    return run


def _hot_keys(rows: DataFrame, id_type: T.DataType, least: int) -> np.ndarray:
    """Hashes of very many pieces, found on a fixed share of the rows. At most ``MOST_HOT``.

    The list only decides how pieces are dealt, never what is found.
    """
    sample = rows.where(F.pmod("row", F.lit(SAMPLE_OF)) == 0)
    cut = sample.mapInArrow(_cut_rows(least, np.empty(0, np.uint64)), _cut_schema(id_type))
    counts = cut.where("content is not null").groupBy("key").count().where(F.col("count") >= HOT_IN_SAMPLE)
    top = counts.orderBy(F.desc("count"), "key").limit(MOST_HOT).select("key").collect()
    return np.array([r.key for r in top], np.int64).view(np.uint64)


def _with_id(id_type: T.DataType, fields: str) -> T.StructType:
    """A schema of the identifier and other fields."""
    rest = T.StructType.fromDDL(fields)
    return T.StructType([T.StructField("id", id_type), *rest.fields])


def _cut_schema(id_type: T.DataType) -> T.StructType:
    return _with_id(id_type, "row long, key long, content int, mark long")


def remove_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least: int = LEAST,
    with_text: bool = False,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Per row: identifier, n_bytes, n_removed, n_spans, spans (bytes, end exclusive), kept_sha256, and
    ``kept`` (binary, null unless ``with_text``).

    ``shard_bytes``: text sorted by one task. Larger shards make fewer tasks and may exceed memory.
    """
    if not GRAM < least <= induced_sort.LONGEST:
        raise ValueError(f"strings must have {GRAM + 1} to {induced_sort.LONGEST} bytes")
    held = pick(docs, id=id_column, text=text_column)
    id_type = held.schema["id"].dataType
    # Rows are told apart by two hashes; rows that agree in both are the same identifier and text.
    rows = held.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"id_hash": F.xxhash64("id"), "row": F.xxhash64("id", F.lit(1), "text")}
    )
    whose = ["id_hash", "row"]

    hot = _hot_keys(rows.select("id", "row", "text"), id_type, least)
    pieces = rows.select("id", "row", "text").mapInArrow(_cut_rows(least, hot), _cut_schema(id_type))
    dealt = pieces.repartition("key").sortWithinPartitions("key", "content", "id", "row", "mark")
    found = dealt.mapInArrow(_judge, _with_id(id_type, "row long, mark long, key long"))
    marks = found.groupBy(F.xxhash64("id").alias("id_hash"), "row").agg(
        F.collect_list(F.struct("mark", "key")).alias("marks")
    )
    once = rows.groupBy(*whose).agg(F.first("id").alias("id"), F.first("text").alias("text"))
    # Laid out by row, so that the texts stay where they are when the sorted marks are joined.
    joined = once.join(marks, whose).select("id", *whose, "text", "marks")
    settled = _with_id(
        id_type, f"id_hash long, row long, text string, marks array<struct<mark: long, key: long>>, {_LEFT}"
    )
    marked = staged_by(joined.mapInArrow(_settle(least, with_text), settled), "repeats_marked", whose)
    waiting = marked.where("text is not null").select("id", *whose, "text", "marks")

    to_sort = F.filter("marks", lambda m: m["key"].isNotNull())
    of_marks = F.aggregate(
        to_sort, F.lit(0).cast("long"), lambda n, m: n + least + F.pmod(m["mark"], F.lit(1 << _WINDOWS))
    )
    size = waiting.agg(F.sum(of_marks)).first()[0] or 0
    shards = (
        waiting.mapInArrow(
            _cut_marked(least),
            _with_id(id_type, "id_hash long, row long, key long, start long, piece binary"),
        )
        .repartition(max(1, -(-size // shard_bytes)), "key")
        .sortWithinPartitions("id", "row", "start")
    )
    sorted_ = shards.mapInArrow(_sort_shard(least), "id_hash long, row long, mark long")
    more = sorted_.groupBy(*whose).agg(F.collect_list("mark").alias("more"))
    removed = waiting.join(more, whose, "left").mapInArrow(
        _remove(least, with_text), f"id_hash long, row long, {_LEFT}"
    )
    removed = removed.unionByName(marked.where("text is null").select(removed.columns))

    whole = rows.select(
        "id", *whose,
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        (F.col("text").cast("binary") if with_text else F.lit(None).cast("binary")).alias("whole"),
    )
    # Rows that agree in everything differ only in that the first one stays.
    counted = whole.groupBy(*whose).agg(
        *[F.first(c).alias(c) for c in ("id", "n_bytes", "sha256", "whole")], F.count(F.lit(1)).alias("copies")
    )
    none = F.array().cast("array<struct<start: long, end: long>>")
    first_copy = F.col("copy") == 1
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    gone = ~first_copy & (F.col("n_bytes") >= least)
    joined = counted.join(removed, whose, "left").withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    )
    spans = F.when(gone, all_).when(first_copy & F.col("spans").isNotNull(), F.col("spans")).otherwise(none)
    left = F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(
        F.when(first_copy, F.coalesce("kept_sha256", "sha256")).otherwise(F.col("sha256"))
    )
    kept = F.when(gone, F.lit("").cast("binary")).otherwise(
        F.when(first_copy, F.coalesce("kept", "whole")).otherwise(F.col("whole"))
    )
    return joined.select(
        F.col("id").alias(id_column),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).when(first_copy, F.coalesce("n_removed", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        spans.alias("spans"),
        left.alias("kept_sha256"),
        kept.alias("kept"),
    )
