"""Packing of token sequences into windows: order-preserving dynamic programming.

Documents of an input partition are laid end to end in their order. Window cuts are
chosen among document ends, sentence ends and, in sentences longer than ``LONG_SENTENCE``
tokens, every ``HARD_STEP`` tokens. The cuts minimise the padding of all windows plus a
penalty for each cut inside a document; a monotone queue of candidate starts makes
each transition constant time. What is left at the end of a partition is cut at powers of
two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hearthtab.llm.common import pick

WINDOW = 4096
END_ID = 2
# Tokens of padding that a cut inside a document must save.
SENTENCE_PENALTY = 8
HARD_PENALTY = 64
LONG_SENTENCE = 1024
HARD_STEP = 64
# Tokens laid out before their cuts are chosen; the last window goes on to the next round.
BLOCK_TOKENS = 64 * WINDOW
# Bounds of the cache of encoded words, per Python worker.
CACHED_WORDS = 150_000
CACHED_LENGTH = 48

_WORD = re.compile(r"[^ \t\n\r\f\v]+")
_ENDS = (".", "!", "?")
# Latin words, which need no normalisation but lower case, and their division: endings after an
# apostrophe, runs of letters, single digits, runs of marks.
_LATIN = [chr(c) for c in range(0x21, 0x250) if c not in (0x85, 0xA0, 0x130) and not 0x7F <= c < 0xA0]
_LETTERS = re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == "L"))
_NUMBERS = re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == "N"))
_SIMPLE = re.compile(f"[{re.escape(''.join(_LATIN))}]+").fullmatch
_PARTS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \t\n\r\f\v{_LETTERS}{_NUMBERS}]+"
).findall
_PLAIN = re.compile(f"[ \t\n\r\f\v{re.escape(''.join(_LATIN))}]*").fullmatch
# Stands for the end of a part in the faster encoder; no plain text holds it.
_PART_END = "\x01"


def _byte_symbols() -> dict[int, str]:
    """Byte to the printable character that stands for it in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


_BYTE_SYMBOLS = _byte_symbols()
# Characters that are encoded together.
_SLICE_CHARS = 1_000_000


class _Words(dict):
    """Ids of words as little-endian bytes; a new word is encoded when first asked for.

    A word of Latin letters, digits and marks is divided the way the tokenizer does it and
    its parts go straight to the tokenizer's model. Any other word goes through the whole tokenizer.
    """

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self._tokenizer = tokenizer
        self._model = tokenizer.model
        self._parts: dict[str, bytes] = {}

    def whole(self, word: str) -> bytes:
        found = self._tokenizer.encode_batch_fast([word], add_special_tokens=False)
        return np.asarray(found[0].ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if _SIMPLE(word) and "<|" not in word:
            parts = self._parts
            ids = b""
            for part in _PARTS(word.lower()):
                known = parts.get(part)
                if known is None:
                    symbols = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_SYMBOLS)
                    tokens = self._model.tokenize(symbols)
                    known = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
                    if len(part) <= CACHED_LENGTH:
                        if len(parts) >= CACHED_WORDS:
                            parts.clear()
                        parts[part] = known
                ids += known
        else:
            ids = self.whole(word)
        if len(word) <= CACHED_LENGTH:
            self[word] = ids
        return ids


_LOADED: dict[str, Encoder] = {}


class Encoder:
    """Token ids of texts, the same as the tokenizer's own for whole texts.

    ``word_bpe`` vocabularies never join characters across ASCII white space. Texts of Latin letters, digits
    and marks are divided into parts, and all parts of a text go to a byte-pair encoder with the same
    merges in one call; other texts are encoded word by word, and the ids of words are kept.
    """

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        self._words = _Words(tokenizer)
        # Tokens that close a sentence: marks at the end of a word.
        closing = np.zeros(tokenizer.get_vocab_size(), bool)
        for token, number in tokenizer.get_vocab().items():
            closing[number] = token.removesuffix("</w>").endswith(_ENDS)
        self._closing = closing
        self._merges = self._byte_pairs(tokenizer)

    @staticmethod
    def _byte_pairs(tokenizer):
        """The merges as ranks of byte strings, in which a part ends with its own byte.

        Numbers of tokens are ranks: single bytes come first, then bytes that end a part, then merges in
        their order. None if the vocabulary is not made that way.
        """
        import tiktoken

        model = json.loads(tokenizer.to_str())["model"]
        byte_of = {symbol: byte for byte, symbol in _BYTE_SYMBOLS.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 512 + k for k, (a, b) in enumerate(merges)):
            return None
        ranks = {}
        for token, number in model["vocab"].items():
            symbols = token.removesuffix("</w>")
            if number < 512 + len(merges) and all(s in byte_of for s in symbols):
                end = _PART_END.encode() if symbols != token else b""
                ranks[bytes(byte_of[s] for s in symbols) + end] = number
        if len(ranks) != 512 + len(merges):
            return None
        return tiktoken.Encoding(
            "parts", pat_str=f"[^{_PART_END}]+{_PART_END}", mergeable_ranks=ranks, special_tokens={}
        )

    @staticmethod
    def loaded(tokenizer_file: str) -> Encoder:
        """The worker process's encoder of a file. Its words stay known from task to task."""
        if tokenizer_file not in _LOADED:
            _LOADED[tokenizer_file] = Encoder(tokenizer_file)
        return _LOADED[tokenizer_file]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text the ids, and the number of ids before each sentence end."""
        plain = [self._merges is not None and "<|" not in t and bool(_PLAIN(t)) for t in texts]
        others = iter(self._encode_words([t for t, p in zip(texts, plain, strict=True) if not p]))
        found = []
        for text, is_plain in zip(texts, plain, strict=True):
            if not is_plain:
                found.append(next(others))
                continue
            parts = _PARTS(text.lower())
            parts.append("")
            ids = np.array(self._merges.encode_ordinary(_PART_END.join(parts)), "<u4")
            found.append((ids, np.flatnonzero(self._closing[ids]) + 1))
        return found

    def _encode_words(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        if not texts:
            return []
        words_of = [_WORD.findall(t) for t in texts]
        if len(self._words) >= CACHED_WORDS:
            self._words.clear()
        parts = list(map(self._words.__getitem__, chain.from_iterable(words_of)))
        ids = np.frombuffer(b"".join(parts), "<u4")
        before = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]) >> 2
        stops = before[np.cumsum([len(w) for w in words_of])]
        closing = np.flatnonzero(self._closing[ids]) + 1
        found, start = [], 0
        for stop in stops.tolist():
            ends = closing[np.searchsorted(closing, start, "right") : np.searchsorted(closing, stop, "right")]
            found.append((ids[start:stop], ends - start))
            start = stop
        return found


def candidate_cuts(length: int, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a document of ``length`` tokens may be cut, and their penalties."""
    inner = np.unique(sentence_ends)
    inner = inner[(inner > 0) & (inner < length)]
    places = np.append(inner, length)
    penalties = np.full(len(places), SENTENCE_PENALTY, np.int64)
    penalties[-1] = 0
    gaps = np.diff(places, prepend=0)
    hard = [
        np.arange(places[k] - gaps[k] + HARD_STEP, places[k], HARD_STEP)
        for k in np.flatnonzero(gaps > LONG_SENTENCE)
    ]
    if hard:
        extra = np.concatenate(hard)
        places = np.concatenate([places, extra])
        penalties = np.concatenate([penalties, np.full(len(extra), HARD_PENALTY, np.int64)])
        order = np.argsort(places, kind="stable")
        places, penalties = places[order], penalties[order]
    return places, penalties


def best_cuts(places: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> list[int]:
    """Window starts of the cheapest division of ``places[-1]`` tokens, the first being 0.

    ``places`` ascends, with steps of at most ``window``. The padding of the last window is free,
    as it is filled later on.
    """
    pos = [0, *places.tolist()]
    fine = [0, *penalties.tolist()]
    last = len(pos) - 1
    cost, back = [0] * (last + 1), [0] * (last + 1)
    # Indices whose cost + place ascends: the first is the best start.
    queue: deque[int] = deque()
    key = [0] * (last + 1)
    for j in range(1, last + 1):
        i = j - 1
        while queue and key[queue[-1]] >= key[i]:
            queue.pop()
        queue.append(i)
        while pos[j] - pos[queue[0]] > window:
            queue.popleft()
        if j == last:
            best = min(queue, key=cost.__getitem__)
            cost[j], back[j] = cost[best], best
        else:
            best = queue[0]
            cost[j] = key[best] + window - pos[j] + fine[j]
            back[j] = best
            key[j] = cost[j] + pos[j]
    starts = []
    j = last
    while j > 0:
        j = back[j]
        starts.append(pos[j])
    return starts[::-1]


def power_of_two_parts(length: int) -> list[int]:
    """Lengths of the binary digits of ``length``, the largest first."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


class _Packer:
    def __init__(self, first_sequence: int) -> None:
        self._next = first_sequence
        # [doc_id, tokens of the document, tokens before what is kept, ids kept, cuts, penalties]
        self._docs: list[list] = []
        self._held = 0
        self.rows: dict[str, list] = {k: [] for k in _FIELDS}

    def add(self, doc_id, ids: np.ndarray, sentence_ends: np.ndarray) -> None:
        places, penalties = candidate_cuts(len(ids), sentence_ends)
        self._docs.append([doc_id, len(ids), 0, ids, places, penalties])
        self._held += len(ids)
        if self._held >= BLOCK_TOKENS:
            self._cut(False)

    def finish(self) -> None:
        if self._docs:
            self._cut(True)

    def _cut(self, final: bool) -> None:
        offsets = np.cumsum([0, *[len(d[3]) for d in self._docs]])
        places = np.concatenate([d[4] - d[2] + o for d, o in zip(self._docs, offsets, strict=False)])
        starts = best_cuts(places, np.concatenate([d[5] for d in self._docs]))
        total = int(offsets[-1])
        if final:
            tail, at = total - starts[-1], starts[-1]
            parts = [tail] if tail == WINDOW else power_of_two_parts(tail)
            starts = starts[:-1] + [at + sum(parts[:k]) for k in range(len(parts))]
            stops = [*starts[1:], total]
        else:
            starts, stops = starts[:-1], starts[1:]
        doc = 0
        for start, stop in zip(starts, stops, strict=True):
            place = start
            while place < stop:
                while offsets[doc + 1] <= place:
                    doc += 1
                until = min(stop, int(offsets[doc + 1]))
                doc_id, tokens, before, ids, _, _ = self._docs[doc]
                piece = ids[place - offsets[doc] : until - offsets[doc]]
                row = (doc_id, before + place - int(offsets[doc]), until - place, piece.tobytes(),
                       tokens, self._next, place - start)
                for name, value in zip(_FIELDS, row, strict=True):
                    self.rows[name].append(value)
                place = until
            self._next += 1
        done = stops[-1] if stops else 0
        kept = []
        for d, o in zip(self._docs, offsets, strict=False):
            gone = min(max(0, done - int(o)), len(d[3]))
            if gone < len(d[3]):
                later = d[4] > d[2] + gone
                kept.append([d[0], d[1], d[2] + gone, d[3][gone:], d[4][later], d[5][later]])
        self._docs = kept
        self._held = total - done


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``_SLICE_CHARS`` characters, with the place of the first."""
    held, size = [], 0
    for k, text in enumerate(texts):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= _SLICE_CHARS:
            yield k + 1 - len(held), held
            held, size = [], 0
    if held:
        yield len(texts) - len(held), held


# Besides the identifier, which keeps its type.
_NUMBERS_AND_IDS = {
    "start": pa.int64(),
    "length": pa.int64(),
    "ids": pa.binary(),
    "doc_tokens": pa.int64(),
    "sequence_id": pa.int64(),
    "offset": pa.int64(),
}
_FIELDS = ("doc_id", *_NUMBERS_AND_IDS)
_BATCH_PIECES = 512


def pack_documents(
    docs: DataFrame, tokenizer_file: str, id_column="doc_id", text_column="text"
) -> DataFrame:
    """Pieces of documents in windows of at most ``WINDOW`` tokens.

    Columns: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset. Each input partition is packed on its own in the order of its rows, so
    nothing is shuffled and a repeated task gives the same windows; ``sequence_id`` carries the
    partition in its upper half. The identifier keeps its type. A null or empty text is the end token alone. A document
    of any length is cut as often as needed; rows with equal identifiers are packed as rows of
    their own. Extra columns are not read. An empty table gives no windows.
    """

    rows = pick(docs, _id=id_column, _text=text_column)
    id_type = rows.schema["_id"].dataType
    schema = [("doc_id", to_arrow_type(id_type)), *_NUMBERS_AND_IDS.items()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.loaded(tokenizer_file)
        packer = _Packer(TaskContext.get().partitionId() << 32)
        end = np.asarray([END_ID], "<u4")

        def taken() -> pa.RecordBatch:
            arrays = [pa.array(packer.rows[k], kind) for k, kind in schema]
            packer.rows = {k: [] for k in _FIELDS}
            return pa.RecordBatch.from_arrays(arrays, names=_FIELDS)

        for batch in batches:
            ids = batch["_id"].to_pylist()
            for start, texts in _slices(batch["_text"]):
                for k, (tokens, ends) in enumerate(encoder.encode(texts), start):
                    packer.add(ids[k], np.append(tokens, end), ends)
                    if len(packer.rows["doc_id"]) >= _BATCH_PIECES:
                        yield taken()
        packer.finish()
        if packer.rows["doc_id"]:
            yield taken()

    pieces = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(
        pack, T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL(pieces).fields])
    )
