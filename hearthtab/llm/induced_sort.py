"""External induced suffix sorting of one shard, with common-prefix values.

The sort follows the induced-sorting recursion: suffixes that start a rise (LMS) are sorted first, by
renaming the stretches between them and sorting the shorter text of names in the same way; from their
order the falling (L) suffixes are induced in ascending and the rising (S) ones in descending order.

The two passes are driven by a monotone priority queue of tuples (first symbol, arrival, position, common
prefix). As tuples arrive in the order of the suffix behind them, a key's tuples leave in the order in
which they came, and their numbers are known beforehand: the queue is laid out with one stretch for each
symbol. Tuples are pushed and popped in blocks. A text of names that is short enough is sorted in memory by
doubling, which ends the recursion. Arrays beyond ``IN_MEMORY`` bytes lie in files of the
executor's scratch folder that have no name, so that nothing remains of them however a task ends.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

IN_MEMORY = 128 << 20
CHUNK = 1 << 20
SMALLEST_BLOCK, LARGEST_BLOCK = 256, 1 << 17
# Texts of names up to this length end the recursion.
IN_MEMORY_SYMBOLS = 1 << 20
# Common prefixes are counted up to this at most.
LONGEST = 240


def scratch(n: int, dtype, fill=None) -> np.ndarray:
    """An array in memory or, if it is large, in a nameless file of the executor's scratch folder."""
    dtype = np.dtype(dtype)
    if n * dtype.itemsize <= IN_MEMORY:
        return np.empty(n, dtype) if fill is None else np.full(n, fill, dtype)
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    with tempfile.TemporaryFile(dir=folder) as file:
        array = np.memmap(file, dtype, "w+", shape=(n,))
    if fill is not None and fill != 0:
        for at in range(0, n, CHUNK):
            array[at : at + CHUNK] = fill
    return array


def _index_type(n: int):
    return np.int32 if n < 1 << 31 else np.int64


def _falling_and_runs(text: np.ndarray, with_runs: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Whether each suffix is larger than the next one, and how often its first symbol repeats."""
    n = len(text)
    falling = scratch(n, bool)
    runs = scratch(n, np.uint8) if with_runs else None
    falling[n - 1] = False
    if with_runs:
        runs[n - 1] = 1
    for hi in range(n - 1, 0, -CHUNK):
        lo = max(0, hi - CHUNK)
        m = hi - lo
        here, behind = text[lo:hi], text[lo + 1 : hi + 1]
        at = np.arange(m)
        change = np.minimum.accumulate(np.where(here == behind, m, at)[::-1])[::-1]
        larger = np.append(here > behind, falling[hi])
        falling[lo:hi] = larger[change]
        if with_runs:
            count = change - at + np.where(change < m, 1, int(runs[hi]))
            runs[lo:hi] = np.minimum(count, LONGEST)
    return falling, runs


def _counts(symbols: np.ndarray, alphabet: int, mask: np.ndarray | None = None) -> np.ndarray:
    total = np.zeros(alphabet, np.int64)
    for at in range(0, len(symbols), CHUNK):
        part = symbols[at : at + CHUNK]
        if mask is not None:
            part = part[mask[at : at + CHUNK]]
        if alphabet <= CHUNK:
            total += np.bincount(part, minlength=alphabet)
        else:
            np.add.at(total, part, 1)
    return total


class _RangeMinimum:
    """Smallest values of stretches of a short array."""

    def __init__(self, values: np.ndarray) -> None:
        rows = [values]
        step = 1
        while 2 * step <= len(values):
            shorter = rows[-1]
            row = values.copy()
            row[: len(values) - step] = np.minimum(shorter[: len(values) - step], shorter[step:])
            rows.append(row)
            step *= 2
        self._rows = np.stack(rows)

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        return np.minimum(self._rows[level, first], self._rows[level, last - (1 << level) + 1])


def _induce(symbols, wanted, alphabet, seeds, seed_prefixes=None, runs=None):
    """All wanted suffixes and the seeds in the order of ``symbols``; with their common prefixes.

    ``seeds`` are sorted and, for an equal first symbol, larger than the wanted suffixes. Each common
    prefix is that with the suffix before in the returned order.
    """
    n = len(symbols)
    coded = scratch(n, np.uint16 if alphabet < 65000 else np.int32)
    for at in range(0, n, CHUNK):
        stretch = slice(at, at + CHUNK)
        coded[stretch] = np.where(wanted[stretch], symbols[stretch].astype(np.int64) + 1, 0)
    n_wanted = _counts(symbols, alphabet, wanted)
    n_seeds = _counts(symbols[seeds], alphabet)
    total = int(n_wanted.sum() + n_seeds.sum())
    queue = scratch(total, _index_type(n), -1)
    head = np.cumsum(n_wanted + n_seeds) - n_wanted - n_seeds
    before = np.cumsum(n_wanted)
    carry = seed_prefixes is not None
    prefixes = scratch(total, np.uint8, 0) if carry else None
    for at in range(0, len(seeds), CHUNK):
        part = seeds[at : at + CHUNK]
        slots = np.arange(at, at + len(part)) + before[symbols[part]]
        queue[slots] = part
        if carry:
            prefixes[slots] = seed_prefixes[at : at + CHUNK]
    if carry:
        both = (n_wanted > 0) & (n_seeds > 0)
        seams = (head + n_wanted)[both]
        prefixes[(head + n_wanted)[~both & (n_seeds > 0)]] = 0
        since = np.full(alphabet, LONGEST, np.uint8)
        pushed = np.zeros(alphabet, bool)
    at, block = 0, SMALLEST_BLOCK
    while at < total:
        popped = queue[at : at + block]
        waiting = popped < 0
        first_waiting = int(waiting.argmax())
        m = first_waiting if waiting[first_waiting] else len(popped)
        # Position 0 has nothing before it: it reads the end mark's code, which is never wanted.
        position = popped[:m] - 1
        code = coded[position]
        source = code.nonzero()[0]
        position, code = position[source], code[source]
        order = np.argsort(code, kind="stable")
        symbol = code[order].astype(np.int64) - 1
        group = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1])) if len(symbol) else order
        size = np.diff(np.append(group, len(symbol)))
        kind = symbol[group]
        slots = head[symbol] + np.arange(len(symbol)) - np.repeat(group, size)
        queue[slots] = position[order]
        head[kind] += size
        if carry:
            here = np.array(prefixes[at : at + m])
            for seam in seams[np.searchsorted(seams, at) : np.searchsorted(seams, at + m)]:
                here[seam - at] = min(runs[queue[seam - 1]], runs[queue[seam]])
                prefixes[seam] = here[seam - at]
            least = _RangeMinimum(here)
            if len(symbol):
                end = source[order]
                start = np.empty(len(end), np.int64)
                start[1:] = end[:-1] + 1
                start[group] = 0
                shared = least(start, end)
                shared[group] = np.minimum(shared[group], since[kind])
                shared = np.minimum(shared, LONGEST - 1) + 1
                shared[group[~pushed[kind]]] = 0
                prefixes[slots] = shared
                pushed[kind] = True
            since = np.minimum(since, here.min())
            if len(symbol):
                last = end[group + size - 1] + 1
                rest = np.full(len(kind), LONGEST, np.uint8)
                inside = last < m
                rest[inside] = least(last[inside], np.full(int(inside.sum()), m - 1))
                since[kind] = rest
        at += m
        block = min(max(2 * m, SMALLEST_BLOCK), LARGEST_BLOCK)
    return queue, prefixes


def _mirrored(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    mirror = scratch(len(symbols), symbols.dtype)
    for at in range(0, len(symbols), CHUNK):
        mirror[at : at + CHUNK] = alphabet - 1 - symbols[at : at + CHUNK].astype(np.int64)
    return mirror


def _rising(falling: np.ndarray) -> np.ndarray:
    """The suffixes that the second pass induces: all rising ones but the end mark."""
    rising = scratch(len(falling), bool)
    for at in range(0, len(falling), CHUNK):
        rising[at : at + CHUNK] = ~falling[at : at + CHUNK]
    rising[len(falling) - 1] = False
    return rising


def _both_passes(text, mirror, falling, rising, alphabet, seeds, seed_prefixes=None, runs=None):
    """All suffixes but the end mark in descending order, with common prefixes if seeds have them."""
    ascending, shared = _induce(text, falling, alphabet, seeds, seed_prefixes, runs)
    is_falling = falling[ascending]
    down = ascending[is_falling][::-1]
    if shared is not None:
        own = shared[is_falling]
        shared = np.append(np.uint8(0), own[1:][::-1]) if len(own) else own
    return _induce(mirror, rising, alphabet, down, shared, runs)


def _names(text: np.ndarray, starts: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the sorted stretches, equal for equal ones. ``following`` has each one's end."""
    length = following - starts
    same = np.append(False, (length[1:] == length[:-1]))
    open_ = np.flatnonzero(same)
    k = 0
    while len(open_):
        equal = text[starts[open_] + k] == text[starts[open_ - 1] + k]
        same[open_[~equal]] = False
        open_ = open_[equal & (length[open_] > k)]
        k += 1
    names = np.cumsum(~same) - 1
    return names, int(names[-1]) + 1


def _sorted_rises(text, mirror, falling, rising, alphabet) -> np.ndarray:
    """The LMS suffixes in ascending order."""
    n = len(text)
    is_lms = np.append(False, ~falling[1:] & falling[:-1])
    lms = np.flatnonzero(is_lms).astype(_index_type(n))
    if len(lms) <= 1:
        return lms
    by_symbol = lms[np.argsort(text[lms], kind="stable")]
    down, _ = _both_passes(text, mirror, falling, rising, alphabet, by_symbol)
    stretches = np.append(lms.dtype.type(n - 1), down[is_lms[down]][::-1])
    del down
    number = scratch(n, lms.dtype)
    number[lms] = np.arange(len(lms), dtype=lms.dtype)
    place = number[stretches]
    del number
    following = np.append(lms[1:], lms[-1])[place]
    names, count = _names(text, stretches, following)
    if count == len(lms):
        return stretches
    shorter = np.empty(len(lms), np.int32 if count < 1 << 31 else np.int64)
    shorter[place] = names
    if len(shorter) <= IN_MEMORY_SYMBOLS:
        return lms[_doubled(shorter)]
    return lms[suffix_order(shorter, count)]


def _doubled(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in ascending order, by doubling the length that ranks cover.

    Only suffixes that still share their rank are sorted again. Needs the unique end mark 0.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    first = np.append(True, text[order[1:]] != text[order[:-1]])
    # A rank is the place of the first suffix of its group.
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    open_ = np.flatnonzero(~(first & np.append(first[1:], True)))
    covered = 1
    while len(open_):
        position = order[open_]
        pair = rank[position] * (n + 1) + rank[np.minimum(position + covered, n - 1)]
        by = np.argsort(pair, kind="stable")
        position, pair = position[by], pair[by]
        # Open places of a group follow each other, so that sorting by rank keeps groups in place.
        order[open_] = position
        first = np.append(True, pair[1:] != pair[:-1])
        rank[position] = open_[np.maximum.accumulate(np.where(first, np.arange(len(open_)), 0))]
        open_ = open_[~(first & np.append(first[1:], True))]
        covered *= 2
    return order


def suffix_order(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Positions of all suffixes in ascending order. The last symbol is 0 and occurs nowhere else."""
    falling, _ = _falling_and_runs(text, False)
    mirror, rising = _mirrored(text, alphabet), _rising(falling)
    seeds = _sorted_rises(text, mirror, falling, rising, alphabet)
    if not len(seeds):
        return np.arange(len(text) - 1, -1, -1)
    down, _ = _both_passes(text, mirror, falling, rising, alphabet, seeds)
    return np.append(down.dtype.type(len(text) - 1), down[::-1])


def _direct_prefixes(text: np.ndarray, sorted_: np.ndarray, longest: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it, compared symbol by symbol."""
    shared = np.zeros(len(sorted_), np.uint8)
    for at in range(1, len(sorted_), CHUNK):
        one, two = sorted_[at - 1 : at + CHUNK - 1], sorted_[at : at + CHUNK]
        two = two[: len(one)]
        one = one[: len(two)]
        open_ = np.arange(len(two))
        for k in range(longest):
            # The end mark is unique, so that no comparison runs over the end.
            equal = text[one[open_].astype(np.int64) + k] == text[two[open_].astype(np.int64) + k]
            open_ = open_[equal]
            if not len(open_):
                break
            shared[at + open_] = k + 1
    return shared


def suffixes_with_prefixes(
    text: np.ndarray, alphabet: int, longest: int = LONGEST
) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes but the end mark in descending order, each with its common prefix with the one
    before it (exact below ``longest``, at least that otherwise).

    The common prefixes of the LMS suffixes are compared once; all others are carried by the queue.
    """
    falling, runs = _falling_and_runs(text, True)
    mirror, rising = _mirrored(text, alphabet), _rising(falling)
    seeds = _sorted_rises(text, mirror, falling, rising, alphabet)
    if not len(seeds):
        return np.arange(len(text) - 1), np.zeros(len(text) - 1, np.uint8)
    return _both_passes(
        text, mirror, falling, rising, alphabet, seeds, _direct_prefixes(text, seeds, longest), runs
    )
