"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns find the base spans. The network, trained in numpy on labelled spans, proposes further
ones in other forms. It runs over overlapping windows wherever a text has a digit or an at sign
(text without either holds none of the kinds); the emissions of overlapping windows
are averaged and decoded together over the whole region by the CRF. A proposal is kept if its
characters can be data of its kind and it touches no base span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthtab.llm.common import pick

# The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The look-behind only saves time: a match never starts inside a run of digits.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")

# Window, overlap and reach around a digit or at sign, in characters.
WINDOW = 64
STRIDE = 32
REACH = 24
_SEED = re.compile(r"[0-9@]")
HIDDEN = 16
# Bounds of the training sample.
SAMPLE_DOCS = 10_000
WINDOWS_PER_DOC = 20
TRAIN_WINDOWS = 2400
MADE_WINDOWS = 1500
EPOCHS = 24
BATCH = 120
RATE = 0.02
TAGS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
_SAMPLE_PARTS = 1_000_000


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        value = int(d) * (2 if k % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in that order."""
    found = []
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            floor = domain.end()
            found.append((start, 0, floor))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# Character classes of the network.
_CLASS_OF = {c: k for k, c in enumerate("@.-_+(), :/%\n\t")}
_DIGITS, _LOWER, _UPPER, _LETTER, _OTHER = range(len(_CLASS_OF), len(_CLASS_OF) + 5)
CLASSES = len(_CLASS_OF) + 6
_PAD = CLASSES - 1


def _class_table() -> np.ndarray:
    table = np.full(0x250, _OTHER, np.int8)
    for c in range(0x250):
        ch = chr(c)
        if ch in _CLASS_OF:
            table[c] = _CLASS_OF[ch]
        elif "0" <= ch <= "9":
            table[c] = _DIGITS
        elif "a" <= ch <= "z":
            table[c] = _LOWER
        elif "A" <= ch <= "Z":
            table[c] = _UPPER
        elif ch.isalpha():
            table[c] = _LETTER
    return table


_TABLE = _class_table()


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], _LETTER)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Parameters by name: input table, recurrence and bias by direction, output, transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
        p = {}
        for way in "fb":
            p[f"in_{way}"] = small(CLASSES, 4 * HIDDEN)
            # Open forget gates at the start.
            p[f"in_{way}"][:, HIDDEN : 2 * HIDDEN] += 1
            p[f"re_{way}"] = small(HIDDEN, 4 * HIDDEN)
        p["out"], p["bias"] = small(2 * HIDDEN, len(TAGS)), np.zeros(len(TAGS), np.float32)
        p["move"] = np.zeros((len(TAGS), len(TAGS)), np.float32)
        return cls(p)

    def _run(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        table, recur = self.p[f"in_{way}"], self.p[f"re_{way}"]
        n, steps = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, steps, HIDDEN), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = table[x[:, t]] + h @ recur
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before_h, before_c = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, before_h, before_c, tc))
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, "f"), self._run(x, "b")], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tag sequences, and its gradients."""
        n, steps = x.shape
        kept = {"f": [], "b": []}
        both = np.concatenate([self._run(x, w, kept[w]) for w in "fb"], axis=2)
        emit = both @ self.p["out"] + self.p["bias"]
        loss, d_emit, d_move = _crf(emit, self.p["move"], y)
        grads = {
            "out": np.einsum("nth,nty->hy", both, d_emit),
            "bias": d_emit.sum(axis=(0, 1)),
            "move": d_move,
        }
        d_both = d_emit @ self.p["out"].T
        for w, d_out in (("f", d_both[:, :, :HIDDEN]), ("b", d_both[:, :, HIDDEN:])):
            recur = self.p[f"re_{w}"]
            d_in, d_re = np.zeros_like(self.p[f"in_{w}"]), np.zeros_like(recur)
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, i, f, o, g, before_h, before_c, tc in reversed(kept[w]):
                dh = dh + d_out[:, t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate(
                    [dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o),
                     dc * i * (1 - g * g)],
                    axis=1,
                )
                np.add.at(d_in, x[:, t], dz)
                d_re += before_h.T @ dz
                dh, dc = dz @ recur.T, dc * f
            grads[f"in_{w}"], grads[f"re_{w}"] = d_in, d_re
        return loss / n, {k: v / n for k, v in grads.items()}


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _crf(emit: np.ndarray, move: np.ndarray, y: np.ndarray):
    """Negative log-likelihood of tags, gradients by emission and transition."""
    n, steps, tags = emit.shape
    ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
    ahead[:, 0] = emit[:, 0]
    for t in range(1, steps):
        ahead[:, t] = _log_sum(ahead[:, t - 1, :, None] + move, 1) + emit[:, t]
    for t in range(steps - 2, -1, -1):
        behind[:, t] = _log_sum(move + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
    total = _log_sum(ahead[:, -1], 1)
    d_emit = np.exp(ahead + behind - total[:, None, None])
    d_move = np.zeros_like(move)
    for t in range(1, steps):
        joint = (
            ahead[:, t - 1, :, None] + move + (emit[:, t] + behind[:, t])[:, None, :]
            - total[:, None, None]
        )
        d_move += np.exp(joint).sum(axis=0)
    np.add.at(d_move, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
    rows, places = np.arange(n)[:, None], np.arange(steps)[None, :]
    gold = emit[rows, places, y].sum() + move[y[:, :-1], y[:, 1:]].sum()
    d_emit[rows, places, y] -= 1
    return float(total.sum() - gold), d_emit, d_move


def viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best tag sequences; ``emit`` is sequences x places x tags."""
    n, steps, tags = emit.shape
    score = emit[:, 0]
    back = np.zeros((n, steps, tags), np.int8)
    for t in range(1, steps):
        paths = score[:, :, None] + move
        back[:, t] = paths.argmax(axis=1)
        score = paths.max(axis=1) + emit[:, t]
    best = np.zeros((n, steps), np.int8)
    best[:, -1] = score.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        best[:, t - 1] = back[np.arange(n), t, best[:, t]]
    return best


def train(windows: list[tuple[str, list[int]]], seed: int = 0) -> Network:
    """Fit on windows of ``WINDOW`` characters and their tags, by Adam."""
    network = Network.new(seed)
    rng = np.random.default_rng(seed)
    x = np.full((len(windows), WINDOW), _PAD, np.int64)
    y = np.zeros((len(windows), WINDOW), np.int64)
    for k, (text, tags) in enumerate(windows):
        x[k, : len(text)] = classes_of(text)
        y[k, : len(tags)] = tags
    first = {k: np.zeros_like(v) for k, v in network.p.items()}
    second = {k: np.zeros_like(v) for k, v in network.p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), BATCH):
            part = order[start : start + BATCH]
            _, grads = network.gradients(x[part], y[part])
            step += 1
            for name, g in grads.items():
                g = np.clip(g, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                change = (first[name] / (1 - 0.9**step)) / (
                    np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6
                )
                network.p[name] = (network.p[name] - RATE * change).astype(np.float32)
    return network


def regions_of(text: str) -> list[tuple[int, int]]:
    """Stretches within ``REACH`` of a digit or at sign."""
    found: list[list[int]] = []
    for m in _SEED.finditer(text):
        start, stop = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if found and start <= found[-1][1]:
            found[-1][1] = stop
        else:
            found.append([start, stop])
    return [(a, b) for a, b in found]


def _windows(start: int, stop: int) -> list[int]:
    """Starts of overlapping windows that cover a region."""
    return list(range(start, max(start + 1, stop - STRIDE), STRIDE))


_EDGE = (1.0 - np.abs(np.arange(WINDOW) - (WINDOW - 1) / 2) / (WINDOW / 2 + 1)).astype(np.float32)
_LONG_REGION = 4096


def propose(network: Network, text: str, regions: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) that the network sees in the regions of a text.

    Long regions are decoded in stretches of ``_LONG_REGION`` characters that overlap by a window,
    each giving the spans that start in its own part.
    """
    found = []
    for a, b in regions:
        for start in range(a, b, _LONG_REGION):
            stop = min(b, start + _LONG_REGION + WINDOW)
            found += [s for s in _decode(network, text, start, stop) if s[0] < start + _LONG_REGION or stop == b]
    return sorted(set(found))


def _decode(network: Network, text: str, start: int, stop: int) -> list[tuple[int, int, int]]:
    x = classes_of(text[start:stop]).astype(np.int64)
    starts = _windows(0, len(x))
    rows = np.full((len(starts), WINDOW), _PAD, np.int64)
    for k, s in enumerate(starts):
        part = x[s : s + WINDOW]
        rows[k, : len(part)] = part
    emit = network.emissions(rows)
    total = np.zeros((starts[-1] + WINDOW, len(TAGS)), np.float32)
    weight = np.zeros(starts[-1] + WINDOW, np.float32)
    for k, s in enumerate(starts):
        total[s : s + WINDOW] += emit[k] * _EDGE[:, None]
        weight[s : s + WINDOW] += _EDGE
    joint = (total / weight[:, None])[: len(x)]
    tags = viterbi(joint[None], network.p["move"])[0]
    return [(start + a, kind, start + b) for a, kind, b in _spans_of(tags)]


def _spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    found, k = [], 0
    while k < len(tags):
        tag = int(tags[k])
        if tag and tag % 2 == 1:
            stop = k + 1
            while stop < len(tags) and tags[stop] == tag + 1:
                stop += 1
            found.append((k, tag // 2, stop))
            k = stop
        else:
            k += 1
    return found


_FORMS = (
    re.compile(r"[\w.%+-]*\w[\w.%+-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}"),
    re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    re.compile(r"[0-9](?:[ .-]?[0-9]){12,18}"),
    re.compile(r"\(?[0-9]{2,5}\)?(?:[ .()/-]{1,2}[0-9]{2,5}){2,5}"),
)


def plausible(text: str, start: int, kind: int, stop: int) -> bool:
    """Whether the characters of a proposal can be data of its kind."""
    value = text[start:stop]
    if not _FORMS[kind].fullmatch(value):
        return False
    near = text[start - 1 : start] + text[stop : stop + 1]
    if any(c.isalnum() or c in "@.-_+/" for c in near.replace(".", "", 1) if c):
        return False
    digits = _NOT_DIGIT.sub("", value)
    if kind == 1:
        return all(int(p) <= 255 for p in value.split("."))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 10 <= len(digits) <= 15
    return True


def find_in(text: str, network: Network | None) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of all spans of a text by start, then kind."""
    base = base_spans(text)
    found = [(a, k, b, True) for a, k, b in base]
    if network is not None:
        regions = regions_of(text)
        if regions:
            edges = np.array([(a, b) for a, _, b in base] or [(0, 0)])
            for a, kind, b in propose(network, text, regions):
                free = not ((edges[:, 0] < b) & (edges[:, 1] > a)).any()
                if free and plausible(text, a, kind, b):
                    found.append((a, kind, b, False))
    return sorted(found)


def _tags_of(length: int, spans: list[tuple[int, int, int]]) -> list[int]:
    tags = [0] * length
    for a, kind, b in spans:
        for k in range(max(0, a), min(length, b)):
            tags[k] = 2 * kind + (1 if k == a else 2)
    return tags


def labelled_windows(text: str, most: int = WINDOWS_PER_DOC) -> list[tuple[str, list[int]]]:
    """Windows around digits and at signs with the tags of whole base spans in them.

    Of overlapping base spans the first is labelled.
    """
    spans: list[tuple[int, int, int]] = []
    for span in base_spans(text):
        if not spans or span[0] >= spans[-1][2]:
            spans.append(span)
    found = []
    for a, b in regions_of(text):
        for s in _windows(a, b):
            stop = min(len(text), s + WINDOW)
            inside = [(x - s, k, y - s) for x, k, y in spans if x < stop and y > s]
            if all(x >= 0 and y <= stop - s for x, _, y in inside):
                found.append((text[s:stop], _tags_of(stop - s, inside)))
            if len(found) >= most:
                return found
    return found


def made_windows(windows: list[tuple[str, list[int]]], count: int, seed: int = 1):
    """Windows with further forms written into untagged ones: national phone numbers, dotted cards,
    addresses with letters beyond ASCII, and numbers that are none of the kinds."""
    rng = np.random.default_rng(seed)
    plain = [w for w in windows if not any(w[1]) and len(w[0]) == WINDOW]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card() -> str:
        body = str(rng.integers(3, 7)) + digits(14)
        last = next(d for d in "0123456789" if luhn(body + d))
        return ".".join(re.findall("....", body + last))

    forms = (
        (3, lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"),
        (3, lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"),
        (3, lambda: f"0{digits(3)} {digits(3)} {digits(4)}"),
        (3, lambda: f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}"),
        (2, card),
        (2, lambda: card().replace(".", " ")),
        (2, lambda: card().replace(".", "")),
        (1, lambda: ".".join(str(x) for x in rng.integers(0, 256, 4))),
        (0, lambda: f"{'abcdefgh'[rng.integers(8)]}.smith{digits(2)}@mail.example.org"),
        (0, lambda: f"jos{'éáüñç'[rng.integers(5)]}{digits(2)}@m{'éäüñ'[rng.integers(4)]}il.com"),
        (None, lambda: f"{digits(4)}-{digits(2)}-{digits(2)}"),
        (None, lambda: f"{digits(3)},{digits(3)},{digits(3)}"),
        (None, lambda: f"{digits(int(rng.integers(1, 9)))}"),
    )
    made = []
    for k in range(count if plain else 0):
        text, _ = plain[int(rng.integers(len(plain)))]
        kind, form = forms[k % len(forms)]
        value = form()
        at = int(rng.integers(2, WINDOW - len(value) - 2))
        text = f"{text[: at - 1]} {value} {text[at + len(value) + 1 :]}"[:WINDOW]
        # The rest must be plain text: its own digits would be unlabelled data.
        rest = _SEED.sub("x", text[:at]) + value + _SEED.sub("x", text[at + len(value) :])
        spans = [] if kind is None else [(at, kind, at + len(value))]
        made.append((rest, _tags_of(len(rest), spans)))
    return made


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_column="doc_id", text_column="text") -> Network | None:
    """Learn from the base spans of a bounded sample of texts and from spans written into them.

    About ``sample_docs`` rows are used, chosen by a hash of the identifier, with up to
    ``WINDOWS_PER_DOC`` windows each. None if they have neither digits nor at signs.
    """
    rows = pick(docs, _id=id_column, _text=text_column).where("_text IS NOT NULL AND _id IS NOT NULL")
    total = docs.count()
    share = round(min(1.0, sample_docs / max(1, total)) * _SAMPLE_PARTS)
    sample = rows.where(F.pmod(F.xxhash64("_id"), F.lit(_SAMPLE_PARTS)) < share)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w for t in batch["_text"] for w in labelled_windows(t.as_py())]
            yield pa.RecordBatch.from_pydict(
                {
                    "text": pa.array([t for t, _ in found], pa.string()),
                    "tags": pa.array(["".join(map(str, tags)) for _, tags in found], pa.string()),
                }
            )

    gathered = sample.select("_text").mapInArrow(cut, "text string, tags string").distinct().collect()
    windows = [(r["text"], [int(c) for c in r["tags"]]) for r in gathered]
    # Windows with spans first, in an order that does not depend on the tasks.
    windows.sort(key=lambda w: (not any(w[1]), xxhash.xxh64_intdigest(w[0]), w[0]))
    if not windows:
        return None
    marked = sum(any(w[1]) for w in windows)
    half = TRAIN_WINDOWS // 2
    chosen = windows[: min(marked, half)] + windows[marked : marked + half]
    return train(chosen + made_windows(windows, MADE_WINDOWS))


SPANS = "array<struct<start: long, rank: int, end: long, kind: string, base: boolean>>"
_SPAN_TYPE = pa.list_(
    pa.struct(
        [
            ("start", pa.int64()),
            ("rank", pa.int32()),
            ("end", pa.int64()),
            ("kind", pa.string()),
            ("base", pa.bool_()),
        ]
    )
)


def find_personal_data(
    docs: DataFrame, network: Network | None, id_column="doc_id", text_column="text"
) -> DataFrame:
    """Spans of personal data of every row: the identifier and ``spans``.

    ``spans`` is an array of (start, rank, end, kind, base) by start and kind; places are code
    points, the end exclusive. A null or empty text has none. Without a network only the base spans are found.
    Whole texts are searched, of any length. Rows with equal identifiers stay rows of their own; extra
    columns are not read; an empty table gives an empty result.
    """
    rows = pick(docs, _id=id_column, _text=text_column)
    kind = rows.schema["_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [
                    {"start": a, "rank": k, "end": b, "kind": KINDS[k], "base": base}
                    for a, k, b, base in find_in(text.as_py() or "", sent.value)
                ]
                for text in batch["_text"]
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], pa.array(spans, _SPAN_TYPE)], names=["_id", "spans"]
            )

    return rows.mapInArrow(run, f"_id {kind}, spans {SPANS}").withColumnRenamed("_id", id_column)


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])
