"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND.

Every training passage (overlapping windows of words) is a query. The weights of an item's
terms are divided by the sum of all its weights, so that a passage with the whole item scores 1.
Items lie in blocks with the greatest weight of each term in each block. A passage whose terms'
greatest weights cannot reach the threshold, at all or in any block, is passed over; the others
walk the posting lists with a pivot, skip blocks whose bounds stay below the threshold, and score what is
left. All items above the threshold are verified: their words must be covered by common five-word
shingles, in the question and the answer (the last sentence; each has two fifths of the words at least).

Items of equal text are one entry of the index. Entries of like lengths have an index each, so that passages
are no longer than those need; term statistics are those of the whole benchmark, in however many indexes and
parts it is searched. Each worker process builds an index once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthtab.llm.common import pick, staged

SHINGLE_WORDS = 5
# Least share of an item's weights in a passage, and of its words in common shingles.
THRESHOLD = 0.6
LEAST_COVER = 0.8
# Cover of the question and of the answer, each on its own.
LEAST_PART_COVER = 0.5
# Least share of an item's words in each of the two. A cover of ``LEAST_COVER`` leaves out a fifth of an item
# at most, which is half of its smaller part at most: where edits stand cannot decide.
LEAST_PART = (1 - LEAST_COVER) / LEAST_PART_COVER
K1, B = 1.2, 0.75
# Shorter items are found only in texts that consist of them: their words occur anywhere.
LEAST_ITEM_WORDS = SHINGLE_WORDS
# Greatest number of words of the first class of lengths; each next class is four times as wide.
FIRST_CLASS = 128
BLOCK_ITEMS = 4
# Greatest table of terms by blocks that is held whole; a larger one is summed up from lists.
TABLE_CELLS = 4_000_000
# Characters of items in one index; a larger benchmark is searched in several passes.
INDEX_CHARS = 64_000_000
# Words of a passage beyond the longest item of the index.
PASSAGE_EXTRA = 48
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Item:
    item_id: object
    words: list[str]
    question_words: int
    shingles: dict[tuple, list[int]] = field(default_factory=dict)

    @classmethod
    def of(cls, item_id, text: str) -> Item:
        sentences = [s for s in _SENTENCE.split(text) if words_of(s)]
        words = words_of(text)
        answer = len(words_of(sentences[-1])) if len(sentences) > 1 else len(words) - len(words) // 2
        # A short part takes words of the other one.
        least = min(math.ceil(LEAST_PART * len(words) - 1e-9), len(words) // 2)
        answer = min(max(answer, least), len(words) - least)
        item = cls(item_id, words, len(words) - answer)
        size = min(SHINGLE_WORDS, len(words))
        for k in range(len(words) - size + 1):
            item.shingles.setdefault(tuple(words[k : k + size]), []).append(k)
        return item

    def cover(self, passage: list[str]) -> tuple[float, float, float]:
        """Shares of all, question and answer words that lie in shingles of the passage."""
        size = min(SHINGLE_WORDS, len(self.words))
        covered = np.zeros(len(self.words), bool)
        for k in range(len(passage) - size + 1):
            for place in self.shingles.get(tuple(passage[k : k + size]), ()):
                covered[place : place + size] = True
        q = self.question_words
        parts = [covered[:q], covered[q:]]
        shares = [float(p.mean()) if len(p) else 1.0 for p in parts]
        return float(covered.mean()), shares[0], shares[1]


@dataclass
class Statistics:
    """Of the whole benchmark: number of entries, mean number of words, entries with each term."""

    entries: int
    mean: float
    frequency: dict[str, int]

    @classmethod
    def of(cls, items: list[Item]) -> Statistics:
        mean = sum(len(i.words) for i in items) / max(1, len(items))
        return cls(len(items), mean, Counter(t for i in items for t in set(i.words)))


class Index:
    """Posting lists of normalised BM25 weights, with block maxima."""

    def __init__(self, items: list[Item], statistics: Statistics | None = None) -> None:
        self.items = items
        self.longest = max(len(i.words) for i in items)
        known = statistics or Statistics.of(items)
        counts = [Counter(i.words) for i in items]
        frequency, mean = known.frequency, known.mean
        self.terms = {t: k for k, t in enumerate(sorted({t for c in counts for t in c}))}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for number, (item, count) in enumerate(zip(items, counts, strict=True)):
            weights = {}
            for term, tf in count.items():
                n = frequency[term]
                idf = math.log(1 + (known.entries - n + 0.5) / (n + 0.5))
                norm = K1 * (1 - B + B * len(item.words) / mean)
                weights[term] = idf * tf * (K1 + 1) / (tf + norm)
            total = sum(weights.values())
            for term, weight in weights.items():
                self.postings[self.terms[term]].append((number, weight / total))
        # The greatest weight of each term, at all and by block of items.
        self.most = np.array([max(w for _, w in p) for p in self.postings] + [0.0], np.float32)
        self.block_most = []
        for posting in self.postings:
            blocks: dict[int, float] = {}
            for number, weight in posting:
                block = number // BLOCK_ITEMS
                blocks[block] = max(blocks.get(block, 0.0), weight)
            self.block_most.append(blocks)
        self.block_ids = [np.fromiter(b.keys(), np.int64, len(b)) for b in self.block_most]
        self.block_weights = [np.fromiter(b.values(), np.float64, len(b)) for b in self.block_most]
        self.block_table = None
        blocks = -(-len(items) // BLOCK_ITEMS)
        if len(self.terms) * blocks <= TABLE_CELLS:
            self.block_table = np.zeros((len(self.terms), blocks))
            for term, (ids, weights) in enumerate(zip(self.block_ids, self.block_weights, strict=True)):
                self.block_table[term, ids] = weights

    def reachable(self, terms: list[int], threshold: float = THRESHOLD) -> bool:
        """Whether the bound of any block reaches the threshold."""
        if self.block_table is not None:
            return bool(self.block_table[terms].sum(axis=0).max() >= threshold - 1e-6)
        blocks = np.concatenate([self.block_ids[t] for t in terms])
        weights = np.concatenate([self.block_weights[t] for t in terms])
        return bool(np.bincount(blocks, weights).max() >= threshold - 1e-6)

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All items scoring ``threshold`` or more for the distinct terms of a passage."""
        end = len(self.items)
        lists = [[self.postings[t], 0, float(self.most[t]), self.block_most[t]] for t in terms]
        found = []
        while lists:
            lists.sort(key=lambda c: c[0][c[1]][0])
            bound, pivot = 0.0, -1
            for k, cursor in enumerate(lists):
                bound += cursor[2]
                if bound >= threshold - 1e-6:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][lists[pivot][1]][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][1]][0] == item:
                pivot += 1
            block = item // BLOCK_ITEMS
            # Only terms up to the pivot can occur in items before the next list's place.
            block_bound = sum(c[3].get(block, 0.0) for c in lists[: pivot + 1])
            if block_bound < threshold - 1e-6:
                # Skip to the end of the block, or to the next list's item if that comes first.
                target = min((block + 1) * BLOCK_ITEMS, end)
                if pivot + 1 < len(lists):
                    target = min(target, lists[pivot + 1][0][lists[pivot + 1][1]][0])
                target = max(target, item + 1)
            elif lists[0][0][lists[0][1]][0] == item:
                score = sum(c[0][c[1]][1] for c in lists[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            for cursor in lists[: pivot + 1]:
                posting, place = cursor[0], cursor[1]
                while place < len(posting) and posting[place][0] < target:
                    place += 1
                cursor[1] = place
            lists = [c for c in lists if c[1] < len(c[0])]
        return found


def _candidates(index: Index, terms: np.ndarray, passage: int, step: int) -> list[int]:
    """Starts of passages whose bound over all items reaches the threshold.

    Repeated terms count more than once here, which only raises the bound.
    """
    total = np.concatenate([[0.0], np.cumsum(index.most[terms], dtype=np.float64)])
    starts = np.arange(0, max(1, len(terms) - passage + step), step)
    stops = np.minimum(starts + passage, len(terms))
    return starts[total[stops] - total[starts] >= THRESHOLD - 1e-4].tolist()


@dataclass
class Part:
    """Entries of one part of the benchmark, and their indexes, which each process builds when first asked."""

    items: list[Item]
    statistics: Statistics | None = None
    _indexes: list[Index] | None = None
    _short: dict[tuple, list[object]] | None = None

    def indexes(self) -> list[Index]:
        if self._indexes is None:
            classes: dict[int, list[Item]] = {}
            self._short = {}
            for item in self.items:
                if len(item.words) < LEAST_ITEM_WORDS:
                    self._short.setdefault(tuple(item.words), []).append(item.item_id)
                else:
                    size = max(0, math.ceil(math.log(len(item.words) / FIRST_CLASS, 4)))
                    classes.setdefault(size, []).append(item)
            known = self.statistics or Statistics.of(self.items)
            self._indexes = [Index(classes[size], known) for size in sorted(classes)]
        return self._indexes

    def found(self, text: str) -> dict[object, tuple[float, float, float, float]]:
        """Entries in a text: cover, score, covers of question and answer; the best of all passages."""
        best = {}
        for index in self.indexes():
            best |= {index.items[k].item_id: v for k, v in matches_in(index, text).items()}
        if self._short:
            best |= dict.fromkeys(self._short.get(tuple(words_of(text)), ()), (1.0,) * 4)
        return best


def matches_in(index: Index, text: str) -> dict[int, tuple[float, float, float, float]]:
    """Verified items in a text: score and covers, the best of all passages."""
    words = words_of(text)
    none = len(index.terms)
    terms = np.fromiter(map(index.terms.get, words, [none] * len(words)), np.int64, len(words))
    passage = index.longest + PASSAGE_EXTRA
    step = PASSAGE_EXTRA
    best: dict[int, tuple[float, float, float, float]] = {}
    for start in _candidates(index, terms, passage, step):
        part = terms[start : start + passage]
        distinct = np.unique(part[part != none])
        if index.most[distinct].sum() < THRESHOLD - 1e-4 or not index.reachable(distinct):
            continue
        for item, score in index.search(distinct.tolist()):
            whole, question, answer = index.items[item].cover(words[start : start + passage])
            if whole >= LEAST_COVER and min(question, answer) >= LEAST_PART_COVER:
                best[item] = max(best.get(item, (0.0,) * 4), (whole, score, question, answer))
    return best


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column="doc_id",
    text_column="text",
    item_column="item_id",
    item_text_column="text",
) -> DataFrame:
    """Documents with a benchmark item: identifier, item, ``score``, ``cover``, ``question_cover``,
    ``answer_cover``; one row per document row and item.

    Documents without one give no row. Items without words are left out; equal items are all
    found, those of less than ``LEAST_ITEM_WORDS`` words only where a text consists of them. A null or empty
    text has no passage; whole texts are read, of any length. The benchmark's distinct texts are split by hash
    into parts of about ``INDEX_CHARS`` characters that are broadcast; usually there is one part. Extra
    columns are not read, and an empty table gives an empty result.
    """
    rows = pick(docs, _id=id_column, _text=text_column).where("_text IS NOT NULL")
    id_kind = rows.schema["_id"].dataType.simpleString()
    hits = None
    for part in _item_parts(benchmark, item_text_column):
        mine = _search(rows, part, id_kind)
        hits = mine if hits is None else hits.unionByName(mine)
    # All items of a text.
    items = pick(benchmark, _item=item_column, _text=item_text_column).where("_text IS NOT NULL")
    found = hits.join(items.select("_item", F.xxhash64("_text").alias("_key")), "_key")
    return found.select(
        F.col("_id").alias(id_column), F.col("_item").alias(item_column),
        "score", "cover", "question_cover", "answer_cover",
    )


def has_leak(benchmark: DataFrame, item_text_column="text") -> list:
    """Column functions, one per part of the benchmark: whether a text holds an item of it."""
    spark = benchmark.sparkSession

    def of(part: Part):
        sent = spark.sparkContext.broadcast(part)

        @F.pandas_udf("boolean")
        def leak(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([bool(t and sent.value.found(t)) for t in batch], dtype=bool)

        return leak

    return [of(part) for part in _item_parts(benchmark, item_text_column)]


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each text, and its number of words."""
    for batch in batches:
        words = [words_of(t) for t in batch["_text"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch["_key"],
                pa.array([sorted(set(w)) for w in words], pa.list_(pa.string())),
                pa.array([len(w) for w in words], pa.int64()),
            ],
            names=["_key", "terms", "size"],
        )


def _item_parts(benchmark: DataFrame, text_column: str) -> Iterator[Part]:
    """Distinct texts with words, in parts of bounded size; one part at least, maybe empty.

    Entries bear the hash of their text. With several parts the statistics of the whole benchmark are
    computed by Spark, and each part gets those of its own terms.
    """
    texts = pick(benchmark, _text=text_column).where("_text IS NOT NULL").distinct()
    texts = texts.withColumn("_key", F.xxhash64("_text"))
    size = texts.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, math.ceil(size / INDEX_CHARS))
    if parts > 1:
        texts = staged(texts, "benchmark")
        terms = staged(texts.mapInArrow(_term_rows, "_key long, terms array<string>, size long").where("size > 0"), "terms")
        whole = terms.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).first()
        each = terms.select("_key", F.explode("terms").alias("term"))
        counts = staged(each.groupBy("term").count(), "term_counts")
    for number in range(parts):
        own = F.pmod(F.col("_key"), F.lit(parts)) == number
        found = [Item.of(r["_key"], r["_text"]) for r in texts.where(own).collect()]
        known = sorted((i for i in found if i.words), key=lambda i: (i.words, i.item_id))
        if parts == 1:
            yield Part(known)
            continue
        mine = each.where(own).select("term").distinct().join(counts, "term")
        yield Part(known, Statistics(whole["n"], whole["mean"], {r["term"]: r["count"] for r in mine.collect()}))


def _search(rows: DataFrame, part: Part, id_kind: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = sent.value
        for batch in batches:
            place, keys, values = [], [], []
            for k, text in enumerate(batch["_text"] if part.items else ()):
                for key, found in sorted(part.found(text.as_py()).items()):
                    place.append(k)
                    keys.append(key)
                    values.append(found)
            columns = list(zip(*values, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["_id"].take(pa.array(place, pa.int64())),
                    pa.array(keys, pa.int64()),
                    *[pa.array(columns[c], pa.float64()) for c in (1, 0, 2, 3)],
                ],
                names=["_id", "_key", "score", "cover", "question_cover", "answer_cover"],
            )

    return rows.mapInArrow(
        run,
        f"_id {id_kind}, _key long, score double, cover double, "
        "question_cover double, answer_cover double",
    )
