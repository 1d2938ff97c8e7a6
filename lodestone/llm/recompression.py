"""Substring dedup by recompression.

The words of all texts are recompressed in rounds. A round first names each maximal run of one symbol by the
symbol and the run's length, then gives every symbol a side by its name and names each pair of a left symbol
followed by a right one. A name is a 64-bit hash of what it stands for, so names are global: every executor gives
equal runs and pairs equal names, and no exchange is needed to agree on them.

A symbol's reach are the words that decide that it exists: its own and those of the neighbours that could have
joined it. A symbol whose reach lies in a window occurs at the same place in every equal window. Each window of 35
words takes as anchor the least such symbol of the highest level that has one (single words always do). Shared
anchors reveal candidates, which carry their words: windows at one place of an anchor whose sequences have equal names
are compared word by word, byte by byte (``repeats`` says when a whole record needs no such look).

Null or empty text: no words. Equal texts and rows repeat each other. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import byte_view
from lodestone.llm.repeats import Anchored, anchor_chunks, anchored, answered, by_anchor, covered, repeated
from lodestone.llm.rolling import BYTE_VALUES, gram_hashes, mix, prefix_sums, slice_hash

ROUNDS = 3
CHUNK_BYTES = 2 << 20
_BYTES = np.arange(256)
IS_BLANK = (_BYTES == 0x20) | (_BYTES >= 0x09) & (_BYTES <= 0x0D)
_RUN, _PAIR, _SIDE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the column's words, the words before each text, and the words' bounds in the column's bytes."""
    data, offsets = byte_view(column)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~IS_BLANK[data]
    move = np.diff(inside)
    cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    cut = np.unique(cut[(inside[cut] == 1) & (inside[cut + 1] == 1)])  # words that touch across texts
    low, high = np.flatnonzero(move == 1), np.flatnonzero(move == -1)
    if len(cut):
        low, high = np.sort(np.concatenate([low, cut])), np.sort(np.concatenate([high, cut]))
    before = np.searchsorted(low, offsets)
    return slice_hash(prefix_sums(BYTE_VALUES[data]), low, high) if len(low) else np.zeros(0, np.uint64), before, low, high


class Level:
    """Symbols of one level: name, first word, reach [left, right), text."""

    def __init__(self, name: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, text: np.ndarray):
        self.name, self.at, self.left, self.right, self.text = name, at, left, right, text

    def joined(self, first: np.ndarray, size: np.ndarray, name: np.ndarray, left: np.ndarray, right: np.ndarray) -> Level:
        return Level(name, self.at[first], left, right, self.text[first])


def _sides(level: Level, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where texts begin, and what the reach gets from the neighbour before and after; a text's edge lies one word outside it."""
    new = np.concatenate([[True], level.text[1:] != level.text[:-1]])
    before = np.where(new, bounds[level.text] - 1, np.concatenate([[0], level.left[:-1]]))
    after = np.where(np.append(new[1:], True), bounds[level.text + 1] + 1, np.append(level.right[1:], 0))
    return new, before, after


def runs(level: Level, bounds: np.ndarray) -> Level:
    """Names maximal runs of one symbol; a single symbol keeps its name, but is only sure next to other ones."""
    new, before, after = _sides(level, bounds)
    begin = np.concatenate([[True], level.name[1:] != level.name[:-1]]) | new
    first = np.flatnonzero(begin)
    size = np.diff(np.append(first, len(level.name)))
    last = first + size - 1
    name = np.where(size > 1, mix(level.name[first] * _RUN + size.astype(np.uint64)), level.name[first])
    return level.joined(first, size, name, np.minimum(before[first], level.left[first]), np.maximum(after[last], level.right[last]))


def pairs(level: Level, bounds: np.ndarray, turn: int) -> Level:
    """Names pairs of a left and a right symbol."""
    new, before, after = _sides(level, bounds)
    right_side = (mix(level.name + mix(np.array([turn], np.uint64) + _SIDE)) >> np.uint64(63)).astype(bool)
    follows = np.zeros(len(level.name), bool)
    follows[1:] = right_side[1:] & ~right_side[:-1] & ~new[1:]
    first = np.flatnonzero(~follows)
    size = np.diff(np.append(first, len(level.name)))
    last = first + size - 1
    name = np.where(size > 1, mix(level.name[first] * _PAIR ^ mix(level.name[last] + _PAIR)), level.name[first])
    alone = size == 1
    left = np.where(alone & right_side[first], np.minimum(before[first], level.left[first]), level.left[first])
    right = np.where(alone & ~right_side[first], np.maximum(after[last], level.right[last]), level.right[last])
    return level.joined(first, size, name, left, right)


def levels(names: np.ndarray, before: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    place = np.arange(len(names))
    now = Level(names, place, place, place + 1, np.repeat(np.arange(len(before) - 1), np.diff(before)))
    out = [now]
    for turn in range(rounds if len(names) else 0):
        now = pairs(runs(now, before), before, turn)
        out.append(now)
    return out


def _least(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The place of the least key in each [low, high), the first of equals; the ranges aren't empty."""
    table, width = [np.arange(len(key))], 1
    most = int((high - low).max(initial=1))
    while 2 * width <= most:
        a = table[-1][: len(key) - 2 * width + 1]
        b = table[-1][width : width + len(a)]
        table.append(np.where(key[b] < key[a], b, a))
        width *= 2
    out = np.empty(len(low), np.int64)
    step = np.frexp(high - low)[1] - 1
    for k in np.unique(step).tolist():
        own = step == k
        a, b = table[k][low[own]], table[k][high[own] - (1 << k)]
        out[own] = np.where(key[b] < key[a], b, a)
    return out


def anchors(names: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """For each window start the number of its anchor, and what gives anchors' first words and names by number."""
    n = max(len(names) - width + 1, 0)
    out, left = np.zeros(n, np.int64), np.arange(n)
    every = levels(names, before)
    bounds = np.cumsum([0, *(len(x.name) for x in every)])
    keys = [mix(x.name + np.uint64(k)) for k, x in enumerate(every)]
    for k in range(len(every) - 1, -1, -1):
        if not len(left):
            break
        low = np.searchsorted(every[k].left, left)
        high = np.searchsorted(every[k].right, left + width, side="right")
        some = high > low
        if some.any():
            out[left[some]] = bounds[k] + _least(keys[k], low[some], high[some])
        left = left[~some]
    at, left, right = (np.concatenate([getattr(x, f) for x in every]) for f in ("at", "left", "right"))
    sums = prefix_sums(names)

    def look(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An anchor's name stands for all words of its reach, which lie in the window, too: short symbols recur by chance."""
        level = np.searchsorted(bounds, number, side="right").astype(np.uint64)
        return at[number], mix(slice_hash(sums, left[number], right[number]) + level + (at[number] - left[number]).astype(np.uint64) * _PAIR)

    return out, look


def scan(column: pa.Array, width: int) -> tuple[Anchored, Callable[[int, int], bytes]]:
    """Records of a column's texts; a record's bytes are its words and what stands between them."""
    names, before, low, high = words(column)
    found = anchored(names, before, width, *anchors(names, before, width))
    data = byte_view(column)[0]
    return found, lambda a, b: data[low[a] : high[b - 2 + width]].tobytes()


def _joined(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    return b" ".join([data[x:y].tobytes() for x, y in zip(low.tolist(), high.tolist(), strict=True)])


def same_windows(data: np.ndarray, low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Which windows of width words, given by the numbers of their first words, are equal; words are data[low:high]."""
    size = high - low
    out = np.ones(len(a), bool)
    # first the words' sizes, then the bytes: windows of equal sizes differ or not at the same places
    for begin in range(0, len(a), 1 << 12):
        x = a[begin : begin + (1 << 12), None] + np.arange(width)
        y = b[begin : begin + (1 << 12), None] + np.arange(width)
        good = (size[x] == size[y]).all(axis=1)
        x, y = x[good], y[good]
        if len(x):
            n = size[x].ravel()
            ends = np.cumsum(n)
            step = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
            differ = data[np.repeat(low[x].ravel(), n) + step] != data[np.repeat(low[y].ravel(), n) + step]
            total = size[x].sum(axis=1)
            good[np.flatnonzero(good)] = np.add.reduceat(differ, np.cumsum(total) - total) == 0
        out[begin : begin + (1 << 12)] = good
    return out


def repeated_windows(h: np.ndarray, off: np.ndarray, column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The record and the place, counted from the anchor, of each window that another record of its anchor has at the same place."""
    name, before, low, high = words(column)
    data = byte_view(column)[0]
    count = np.maximum(np.diff(before) - width + 1, 0)
    record = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(record)) - np.repeat(np.cumsum(count) - count, count)
    place, first = nth - off[record], before[record] + nth
    window = gram_hashes(prefix_sums(name), width)[first] if len(first) else np.zeros(0, np.uint64)
    order = np.lexsort((window, place, h[record]))
    near = (window[order][1:] == window[order][:-1]) & (place[order][1:] == place[order][:-1]) & (h[record][order][1:] == h[record][order][:-1])
    pair = np.flatnonzero(near)
    equal = same_windows(data, low, high, first[order[pair]], first[order[pair + 1]], width)
    again = np.zeros(len(record), bool)
    again[order[pair[equal]]] = again[order[pair[equal] + 1]] = True
    if not equal.all():  # different windows of one name: all windows of these names are told apart by their words
        odd = np.isin(window, window[order[pair[~equal]]])
        again[odd] = False
        groups: dict[tuple, list[int]] = {}
        for i in np.flatnonzero(odd).tolist():
            groups.setdefault((int(h[record[i]]), int(place[i]), _joined(data, low[first[i] : first[i] + width], high[first[i] : first[i] + width])), []).append(i)
        for own in groups.values():
            again[own] = len(own) > 1
    return record[again], place[again]


def verifier(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in anchor_chunks(batches, CHUNK_BYTES):
            own, at = repeated_windows(whole.column("h").to_numpy(), whole.column("off").to_numpy(), whole.column("data").combine_chunks(), width)
            yield answered(whole, np.split(np.stack([at, at + 1], axis=1).ravel(), 2 * np.searchsorted(own, np.arange(1, whole.num_rows))))

    return run


def recompression_dedup(docs: DataFrame, width: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs (doc_id, text)."""

    def finish(texts: list[bytes], starts: list[np.ndarray]) -> list[tuple]:
        out = []
        for text, own in zip(texts, starts, strict=True):
            parts = text.split()
            kept, low = [], 0
            for a, b in covered(own, width):
                kept += parts[low:a]
                low = b
            kept += parts[low:]
            out.append((len(parts), len(parts) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return out

    return repeated(docs, lambda column: scan(column, width), width, by_anchor(verifier(width)), finish, "n_words long, n_removed long, kept_sha256 string", settled=True)
