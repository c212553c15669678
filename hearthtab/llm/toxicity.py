"""Toxicity: support vector machines with a gapped subsequence string kernel, over words and documents.

The kernel compares two words by their common subsequences of four symbols inside a stretch of
``SPAN`` symbols, each weighted by ``DECAY`` to the length of its stretch, so that gaps and
inserted characters cost little. Words are mapped to the kernel's values at landmark
words (Nystroem). Two linear machines with squared hinge loss are trained on the mapped words: the first
tells suspect words from others; the second is trained on the labelled documents, each the sum of its
distinct suspect words, so that one word that never stands in clean text decides alone and words that
also occur by chance need others beside them. As decisions are sums of kernel values, they equal one weight
per subsequence, and words are scored with those weights: the scores are the same, without a kernel value
per landmark.

Labels belong to documents. Which words are suspect is learned from them: words with a piece that is much
more frequent in unrelated toxic documents than in clean ones. Single clean documents that quote insults,
and single wrong labels, weigh as little as their share.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthtab.llm.common import pick

ORDER = 4
SPAN = 6
DECAY = 0.7
# Symbols: word edge, 26 letters, and classes for all others.
SYMBOLS = 40
# A longer word is scored by pieces of this size, each overlapping the next by half.
LONGEST = 24
# Bounds of the training sample, in documents, and of what is learned from it.
SAMPLE_TOXIC = 2000
SAMPLE_CLEAN = 6000
WORDS_PER_PIECE = 60
CLEAN_WORDS = 12_000
HARD_WORDS = 4000
LANDMARKS = 192
ROUNDS = 4
COST = 10.0
# Suspect pieces: sizes, least number of unrelated toxic documents, how much more frequent than in clean ones,
# and the chance of an accidental piece that is still taken.
GRAM_SIZES = (4, 5, 6, 7)
LEAST_GROUPS = 5
LEAST_RATIO = 6.0
ACCIDENT = 1e-7
BAD_WORDS = 6000
DOCUMENT_COST = 1.0
# Share of the sample's clean documents that may lie above the border, and how far the border may be moved
# for it: single wrong labels must not move it far.
CLEAN_SHARE = 0.002
LOWEST_BORDER, HIGHEST_BORDER = -0.12, 0.1
# Bound of the cache of scored words, per Python worker.
CACHED_WORDS = 200_000

_WORD = re.compile(r"[^ \t\n\r\f\v]+")
_SAMPLE_PARTS = 1_000_000
_CHUNK_WORDS = 2048
_SCORE_STEEPNESS = 4.0


def normal(word: str) -> str:
    """Letters and digits of a word in lower case; edges are marked."""
    low = word.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFC", low)
    letters = "".join(c for c in low if c.isalnum())
    return f"^{letters}^" if letters else ""


def codes(word: str) -> list[int]:
    return [
        0 if c == "^" else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (SYMBOLS - 27)
        for c in word
    ]


def pieces_of(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    half = LONGEST // 2
    return [word[k : k + LONGEST] for k in range(0, len(word) - half, half)]


@lru_cache(maxsize=64)
def _places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """All subsequences within ``SPAN``: their indices, and the weight of their stretch."""
    chosen, weight = [], []
    for first in range(length - ORDER + 1):
        for rest in combinations(range(first + 1, min(length, first + SPAN)), ORDER - 1):
            chosen.append((first, *rest))
            weight.append(DECAY ** (rest[-1] - first + 1))
    return np.array(chosen, np.int64).reshape(-1, ORDER), np.array(weight)


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length, in bounded chunks: places of the words, subsequence numbers (words x entries),
    normalised values.

    Equal subsequences of a word appear as several entries; the norm takes their sum.
    """
    by_length = defaultdict(list)
    for k, word in enumerate(words):
        by_length[len(word)].append(k)
    for length, all_places in by_length.items():
        index, weight = _places(length)
        if not len(index):
            continue
        for start in range(0, len(all_places), _CHUNK_WORDS):
            places = all_places[start : start + _CHUNK_WORDS]
            symbols = np.array([codes(words[k]) for k in places], np.int64)
            number = np.zeros((len(places), len(index)), np.int64)
            for k in range(ORDER):
                number = number * SYMBOLS + symbols[:, index[:, k]]
            order = np.argsort(number, axis=1)
            sorted_number = np.take_along_axis(number, order, axis=1)
            # Sum of values over runs of equal numbers, squared and summed.
            new = np.ones(number.shape, bool)
            new[:, 1:] = sorted_number[:, 1:] != sorted_number[:, :-1]
            flat = np.flatnonzero(new.ravel())
            sums = np.add.reduceat(weight[order].ravel(), flat)
            norm = np.sqrt(np.bincount(flat // number.shape[1], sums * sums, len(places)))
            yield np.array(places), number, weight[None, :] / norm[:, None]


def feature_rows(words: list[str]) -> list[dict[int, float]]:
    rows: list[dict[int, float]] = [{} for _ in words]
    for places, number, value in subsequences(words):
        for place, numbers, values in zip(places.tolist(), number.tolist(), value.tolist(), strict=True):
            row = rows[place]
            for n, v in zip(numbers, values, strict=True):
                row[n] = row.get(n, 0.0) + v
    return rows


def kernel_with(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of words at landmarks, by spreading the landmarks over their subsequences."""
    out = np.zeros((len(words), len(landmarks)))
    rows = feature_rows(landmarks)
    used = sorted({n for row in rows for n in row})
    place = np.zeros(SYMBOLS**ORDER, np.int64)
    place[used] = np.arange(1, len(used) + 1)
    dense = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for k, row in enumerate(rows):
        for n, v in row.items():
            dense[place[n], k] = v
    for places, number, value in subsequences(words):
        for start in range(0, len(places), 256):
            part = slice(start, start + 256)
            spot = place[number[part]]
            out[places[part]] = np.einsum("wel,we->wl", dense[spot], value[part].astype(np.float32))
    return out


def train_svm(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, cost: float = COST) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    y = np.where(labels, 1.0, -1.0)
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6

    def loss(v: np.ndarray) -> float:
        slack = np.maximum(0.0, 1 - y * (x @ v))
        return 0.5 * v @ ridge @ v + cost * float(weights @ (slack * slack))

    now = loss(w)
    for _ in range(50):
        margin = 1 - y * (x @ w)
        on = margin > 0
        xs, ws = x[on], weights[on]
        gradient = ridge @ w - 2 * cost * xs.T @ (ws * y[on] * margin[on])
        step = np.linalg.solve(ridge + 2 * cost * (xs * ws[:, None]).T @ xs, gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        after = loss(w)
        if now - after <= 1e-9 * max(1.0, now):
            break
        now = after
    return w


@dataclass(frozen=True)
class ToxicityModel:
    weight: np.ndarray  # one number per subsequence: suspect words
    bias: float
    # One number per subsequence: what a suspect word adds to its document.
    share: np.ndarray = field(default_factory=lambda: np.zeros(SYMBOLS**ORDER, np.float32))
    size_share: np.ndarray = field(default_factory=lambda: np.zeros(2))  # of each measure of a document's size
    document_bias: float = -1.0

    def margins(self, words: list[str]) -> np.ndarray:
        """Whether words are suspect (above 0); a word without subsequences gets -1."""
        out = np.full(len(words), -1.0)
        for places, number, value in subsequences(words):
            out[places] = (self.weight[number] * value).sum(axis=1) + self.bias
        return out

    def shares(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for places, number, value in subsequences(words):
            out[places] = (self.share[number] * value).sum(axis=1)
        return out


# Scores like text without a suspect word.
NO_MODEL = ToxicityModel(np.zeros(SYMBOLS**ORDER, np.float32), -1.0)


def size_measures(n_words) -> np.ndarray:
    """Measures of the number of distinct words: long texts have more suspect words by chance."""
    n = np.asarray(n_words, float)
    return np.stack([np.sqrt(n) / 30, n / 1000], axis=-1)


def _grams(word: str) -> set[str]:
    return {word[k : k + n] for n in GRAM_SIZES for k in range(len(word) - n + 1)}


def _unrelated(signatures: list[tuple]) -> list[int]:
    """Number of the group of each document; documents sharing a signature are copies."""
    parent = list(range(len(signatures)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    first: dict = {}
    for k, signature in enumerate(signatures):
        for part in signature:
            other = root(first.setdefault(part, k))
            mine = root(k)
            if other != mine:
                parent[max(other, mine)] = min(other, mine)
    return [root(k) for k in range(len(signatures))]


@dataclass
class Evidence:
    """What the sample says: distinct words of each document, and the group of related ones it is in."""

    toxic: list[list[str]]
    toxic_group: list[int]
    clean: list[list[str]]
    clean_group: list[int]


def gather(sample: Iterator[tuple[bool, list[str], tuple]]) -> Evidence:
    """From (toxic, distinct normal words, signatures) of documents."""
    held: dict[bool, list] = {True: [], False: []}
    pool: dict[str, str] = {}
    for is_toxic, words, signature in sample:
        held[is_toxic].append((signature, [pool.setdefault(w, w) for w in words]))
    parts = []
    for label in (True, False):
        held[label].sort()
        parts += [[words for _, words in held[label]], _unrelated([s for s, _ in held[label]])]
    return Evidence(*parts)


def _support(documents: list[list[str]], group: list[int]) -> tuple[Counter, int]:
    """Number of groups with each word, and of groups."""
    words_of: dict[int, set[str]] = defaultdict(set)
    for number, words in zip(group, documents, strict=True):
        words_of[number].update(words)
    support: Counter = Counter()
    for words in words_of.values():
        support.update(words)
    return support, len(words_of)


def suspect_pieces(toxic: Counter, n_toxic: int, clean: Counter, n_clean: int) -> set[str]:
    """Pieces much more frequent in toxic groups than in clean ones, beyond any chance.

    Supports of a piece are summed over the words that hold it.
    """
    both = []
    for words in (toxic, clean):
        grams: Counter = Counter()
        for word, n in words.items():
            for gram in _grams(word):
                grams[gram] += n
        both.append(grams)
    share = n_toxic / (n_toxic + n_clean)
    found = set()
    for gram, n in both[0].items():
        other = both[1].get(gram, 0)
        if n < LEAST_GROUPS or n * n_clean < LEAST_RATIO * max(other, 0.5) * n_toxic:
            continue
        # Chernoff's bound on so many toxic ones among all groups with the piece.
        part = n / (n + other)
        distance = math.log(part / share) * part
        if other:
            distance += math.log((1 - part) / (1 - share)) * (1 - part)
        if (n + other) * distance >= -math.log(ACCIDENT):
            found.add(gram)
    return found


def _collapsed(landmarks: list[str], alpha: np.ndarray) -> np.ndarray:
    """One weight per subsequence from one per landmark."""
    dense = np.zeros(SYMBOLS**ORDER)
    for row, a in zip(feature_rows(landmarks), alpha, strict=True):
        for n, v in row.items():
            dense[n] += a * v
    return dense.astype(np.float32)


def learn(evidence: Evidence) -> ToxicityModel | None:
    """Fit on the evidence; None without both labels, or if no word tells them apart."""
    toxic_words, n_toxic = _support(evidence.toxic, evidence.toxic_group)
    clean_words, n_clean = _support(evidence.clean, evidence.clean_group)
    if not n_toxic or not n_clean:
        return None
    pieces = suspect_pieces(toxic_words, n_toxic, clean_words, n_clean)
    words_with: dict[str, list[str]] = defaultdict(list)
    for word in sorted(toxic_words, key=lambda w: (-toxic_words[w], w)):
        # More frequent in toxic documents as a whole word, too.
        if toxic_words[word] * n_clean > LEAST_RATIO * clean_words[word] * n_toxic:
            for gram in _grams(word) & pieces:
                if len(words_with[gram]) < WORDS_PER_PIECE:
                    words_with[gram].append(word)
    bad = sorted({w for words in words_with.values() for w in words})
    if not bad:
        return None
    spread = lambda words, n: sorted(words, key=lambda w: xxhash.xxh64_intdigest(w, 7))[:n]
    # The most frequent of the suspect ones: every kind of insult is among them.
    bad = sorted(bad, key=lambda w: (-toxic_words[w], w))[:BAD_WORDS]
    frequent = sorted((w for w in clean_words if not _grams(w) & pieces), key=lambda w: (-clean_words[w], w))
    rest = sorted(frequent[CLEAN_WORDS // 2 :], key=lambda w: xxhash.xxh64_intdigest(w))
    good = frequent[: CLEAN_WORDS // 2] + rest[: CLEAN_WORDS // 2]
    if not good:
        return None
    landmarks = spread([p for w in bad for p in pieces_of(w)], LANDMARKS * 2 // 3)
    landmarks += spread([p for w in good for p in pieces_of(w)], LANDMARKS // 3)
    landmarks = sorted(set(landmarks))
    # Nystroem: kernel among landmarks to the power -1/2, small eigenvalues left out.
    values, vectors = np.linalg.eigh(kernel_with(landmarks, landmarks))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    first = NO_MODEL
    for _ in range(ROUNDS):
        words = [p for w in bad for p in pieces_of(w)] + [p for w in good for p in pieces_of(w)]
        n_bad = sum(len(pieces_of(w)) for w in bad)
        labels = np.arange(len(words)) < n_bad
        weights = np.where(labels, len(words) / (2 * n_bad), len(words) / (2 * (len(words) - n_bad)))
        w = train_svm(kernel_with(words, landmarks) @ root, labels, weights)
        first = ToxicityModel(_collapsed(landmarks, root @ w[:-1]), float(w[-1]))
        # The clean words nearest to the wrong side join the next round.
        others = sorted(set(frequent).difference(good))
        if not others:
            break
        margin = first.margins([x[:LONGEST] for x in others])
        hard = np.argsort(-margin, kind="stable")[:HARD_WORDS]
        added = [others[k] for k in hard if margin[k] > -0.9]
        if not added:
            break
        good = good + added
    return _learn_documents(evidence, first, landmarks, root)


def _learn_documents(
    evidence: Evidence, first: ToxicityModel, landmarks: list[str], root: np.ndarray
) -> ToxicityModel:
    """The machine over documents: sums of their suspect words."""
    documents = evidence.toxic + evidence.clean
    labels = np.arange(len(documents)) < len(evidence.toxic)
    words = sorted({w for d in documents for w in d})
    pieces = [pieces_of(w) for w in words]
    margin = first.margins([p for ps in pieces for p in ps])
    starts = np.cumsum([0, *[len(ps) for ps in pieces[:-1]]])
    suspect = np.flatnonzero(np.maximum.reduceat(margin, starts) > 0)
    best = {}
    for k in suspect.tolist():
        own = margin[starts[k] : starts[k] + len(pieces[k])]
        best[words[k]] = pieces[k][int(own.argmax())]
    place = {w: k for k, w in enumerate(best)}
    mapped = kernel_with(list(best.values()), landmarks) @ root
    rows = np.zeros((len(documents), mapped.shape[1]))
    for k, document in enumerate(documents):
        own = [place[w] for w in document if w in place]
        if own:
            rows[k] = mapped[own].sum(axis=0)
    rows = np.hstack([rows, size_measures([len(d) for d in documents])])
    # Copies together weigh as much as one document; both labels weigh the same.
    weights = np.zeros(len(documents))
    for group, mine in ((evidence.toxic_group, labels), (evidence.clean_group, ~labels)):
        sizes = Counter(group)
        weights[mine] = [1 / (sizes[g] * len(sizes)) for g in group]
    weights *= len(documents) / 2
    w = train_svm(rows, labels, weights, DOCUMENT_COST)
    decision = rows @ w[:-1] + w[-1]
    # The border leaves all but a small share of clean documents below it.
    clean = np.sort(decision[~labels])
    border = float(clean[math.ceil((1 - CLEAN_SHARE) * len(clean)) - 1])
    border = min(max(border, LOWEST_BORDER), HIGHEST_BORDER)
    n = mapped.shape[1]
    return ToxicityModel(
        first.weight, first.bias, _collapsed(landmarks, root @ w[:n]), w[n:-1], float(w[-1]) - border
    )


def _signatures(text: str) -> list[int]:
    """Smallest hashes of five-word shingles under four seeds."""
    words = text.split()
    lines = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    return [
        (min(xxhash.xxh64_intdigest(x, seed) for x in lines) >> 3) * 4 + seed for seed in range(4)
    ]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample_toxic: int = SAMPLE_TOXIC,
    sample_clean: int = SAMPLE_CLEAN,
    id_column="doc_id",
    text_column="text",
    label_column="toxic",
) -> ToxicityModel | None:
    """Learn from labelled documents (label 1: toxic, 0: clean); None if one label is missing.

    About ``sample_toxic`` toxic and ``sample_clean`` clean documents are used at most, chosen by a
    hash of the identifier among the labels; tasks reduce them to their distinct words. Labels
    other than 0 and 1, and rows without a text or identifier, are left out; a document with both
    labels counts as toxic.
    """
    rated = (
        pick(labels, _id=id_column, _label=label_column)
        .where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
    )
    sizes = {r["_label"]: r["count"] for r in rated.groupBy("_label").count().collect()}
    if len(sizes) < 2:
        return None
    parts = {
        label: round(min(1.0, most / sizes[label]) * _SAMPLE_PARTS)
        for label, most in ((1, sample_toxic), (0, sample_clean))
    }
    limit = F.when(F.col("_label") == 1, F.lit(parts[1])).otherwise(F.lit(parts[0]))
    sample = rated.where(F.pmod(F.xxhash64("_id"), F.lit(_SAMPLE_PARTS)) < limit)
    # Bounded by the two sample sizes, whatever the data.
    chosen = pick(docs, _id=id_column, _text=text_column).join(F.broadcast(sample), "_id").where(
        F.col("_text").isNotNull()
    )

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["_text"].to_pylist()
            yield pa.RecordBatch.from_pydict(
                {
                    "toxic": pa.array([x == 1 for x in batch["_label"].to_pylist()], pa.bool_()),
                    "words": pa.array(
                        [" ".join(sorted({normal(w) for w in _WORD.findall(t)} - {""})) for t in texts],
                        pa.string(),
                    ),
                    "signatures": pa.array([_signatures(t) for t in texts], pa.list_(pa.int64())),
                }
            )

    gathered = chosen.select("_text", "_label").mapInArrow(
        reduce, "toxic boolean, words string, signatures array<long>"
    )
    sample = (
        (r["toxic"], r["words"].split(), tuple(r["signatures"])) for r in gathered.toLocalIterator()
    )
    return learn(gather(sample))


class Scorer:
    """Decision values of texts."""

    def __init__(self, model: ToxicityModel) -> None:
        self._model = model
        # Word to its normal form and what it adds to a document.
        self._known: dict[str, tuple[str, float]] = {}

    def _learn(self, unseen: set[str]) -> None:
        shapes = {w: normal(w) for w in unseen}
        pieces = sorted({p for shape in shapes.values() if shape for p in pieces_of(shape)})
        margins = dict(zip(pieces, self._model.margins(pieces).tolist(), strict=True))
        best = {}
        for shape in set(shapes.values()) - {""}:
            piece = max(pieces_of(shape), key=margins.__getitem__)
            if margins[piece] > 0:
                best[shape] = piece
        shares = dict(zip(best, self._model.shares(list(best.values())).tolist(), strict=True))
        for word, shape in shapes.items():
            self._known[word] = (shape, shares.get(shape, 0.0))

    def __call__(self, texts: list[str]) -> np.ndarray:
        words_of = [set(_WORD.findall(t)) for t in texts]
        unseen = set().union(*words_of).difference(self._known)
        if len(self._known) + len(unseen) > CACHED_WORDS:
            self._known.clear()
            unseen = set().union(*words_of)
        if unseen:
            self._learn(unseen)
        known = self._known
        sums, sizes = [], []
        for words in words_of:
            # Distinct by normal form, as in training.
            shapes = dict(map(known.__getitem__, words))
            shapes.pop("", None)
            sums.append(sum(shapes.values()))
            sizes.append(len(shapes))
        for word in [w for w in unseen if len(w) > 2 * LONGEST]:
            del known[word]
        return np.array(sums) + size_measures(sizes) @ self._model.size_share + self._model.document_bias


_SLICE_CHARS = 1_000_000


def toxicity_score(spark: SparkSession, model: ToxicityModel | None):
    """Column function: score of each text; without a model all score like clean words."""
    sent = spark.sparkContext.broadcast(model or NO_MODEL)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for batch in batches:
            margins, held, size = [np.zeros(0)], [], 0
            for text in batch:
                held.append(text or "")
                size += len(held[-1])
                if size >= _SLICE_CHARS:
                    margins.append(scorer(held))
                    held, size = [], 0
            if held:
                margins.append(scorer(held))
            yield pd.Series(1 / (1 + np.exp(-_SCORE_STEEPNESS * np.concatenate(margins))))

    return score


def score_toxicity(
    docs: DataFrame, model: ToxicityModel | None, id_column="doc_id", text_column="text"
) -> DataFrame:
    """Score (0 to 1) and prediction of every text: the identifier, ``score``, ``predicted``.

    Whole texts are scored, of any length. A null, empty or wordless text scores like one without a
    suspect word, as does every text if there is no model. Rows with equal identifiers stay rows of
    their own; extra columns are not read; an empty table gives an empty result.
    """
    rows = pick(docs, _id=id_column, _text=text_column)
    score = toxicity_score(docs.sparkSession, model)
    return rows.select(F.col("_id").alias(id_column), score("_text").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
