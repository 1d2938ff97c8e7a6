"""Benchmark decontamination by an FM-index for each training shard.

A shard is a block of documents. Words are numbered by the benchmark's vocabulary; stretches that hold no other
word and are long enough for a window are the shard's text, everything else is a separator. Their suffixes are
sorted, the Burrows-Wheeler transform is kept as a wavelet matrix of packed bits, test phrases are searched
backward by its ranks all at once, and occurrences are located by steps to sampled suffix positions. The words
of all occurrences merge into removal spans.

The benchmark is a stated query set: long items are cut into parts that overlap by a window, and the parts are taken
in blocks of about ``block_bytes`` of text. One block's phrases, of that bounded size, are broadcast for one pass over
the shards; before the next block the hits so far are written to the shared folder and the broadcast is destroyed.

Null text or item: no words. An item of fewer words than ``width`` is one window; one of none has no window.
Repeated items each count by their id; a null item_id is not an item. Repeated documents are searched each.
Other columns are not read, or, by ``decontaminate``, pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lodestone.llm.common import arrow_blocks, byte_view, free_name, map_arrow, stored, text_column
from lodestone.llm.rolling import BYTE_VALUES, prefix_sums, slice_hash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BYTES = np.arange(256)
IS_WORD = (_BYTES >= 0x80) | (_BYTES >= 0x30) & (_BYTES <= 0x39) | (_BYTES >= 0x61) & (_BYTES <= 0x7A) | (_BYTES >= 0x41) & (_BYTES <= 0x5A)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES)
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SHARD_BYTES = 1 << 20


def lower_ascii(text: str) -> str:
    return text.translate(_UPPER)


class Wavelet:
    """Ranks over a sequence of small whole numbers, as packed bit planes with counts by 64 bits."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.n, self.planes = len(symbols), []
        now = symbols
        for level in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            packed = np.packbits(np.pad(bit, (0, -len(bit) % 64 + 64)), bitorder="little").view(np.uint64)
            counts = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            zeros = len(bit) - int(counts[-1])
            self.planes.append((level, packed, counts, zeros))
            now = np.concatenate([now[~bit], now[bit]])
        self.begin = {}

    @staticmethod
    def _ones(packed: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return counts[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << rest) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each of the places."""
        now = [np.zeros(len(symbol), np.int64), *places]
        for level, packed, counts, zeros in self.planes:
            one = (symbol >> level & 1).astype(bool)
            ones = [self._ones(packed, counts, x) for x in now]
            now = [np.where(one, zeros + k, x - k) for x, k in zip(now, ones, strict=True)]
        return [x - now[0] for x in now[1:]]

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        symbol, now, begin = np.zeros(len(place), np.int64), place, np.zeros(len(place), np.int64)
        for level, packed, counts, zeros in self.planes:
            one = packed[now >> 6] >> (now & 63).astype(np.uint64) & np.uint64(1) == 1
            symbol |= one.astype(np.int64) << level
            a, b = self._ones(packed, counts, now), self._ones(packed, counts, begin)
            now, begin = np.where(one, zeros + a, now - a), np.where(one, zeros + b, begin - b)
        return symbol, now - begin


class FMIndex:
    """Over symbols >= 0; a final sentinel below all others is added."""

    def __init__(self, symbols: np.ndarray, sample: int = 16):
        text = np.concatenate([symbols.astype(np.int64) + 1, [0]])
        order = suffix_order(text)
        before = text[order - 1]
        top = int(text.max())
        self.n, self.sample, self.wavelet = len(text), sample, Wavelet(before, top)
        self.first = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=top + 1), out=self.first[1:])
        self.marked = order % sample == 0
        self.place = np.cumsum(self.marked) - 1
        self.samples = order[self.marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of the suffixes that begin with each phrase of an (n, length) array."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, j].astype(np.int64) + 1
            known = symbol < len(self.first) - 1
            low[alive[~known]] = high[alive[~known]] = 0
            alive, symbol = alive[known], symbol[known]
            if not len(alive):
                break
            a, b = self.wavelet.rank(symbol, low[alive], high[alive])
            low[alive], high[alive] = self.first[symbol] + a, self.first[symbol] + b
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of rows: steps back until a sampled one."""
        out, now, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.marked[now]
            out[left[done]] = self.samples[self.place[now[done]]] + steps
            left, now = left[~done], now[~done]
            if len(left):
                symbol, rank = self.wavelet.access(now)
                now, steps = self.first[symbol] + rank, steps + 1
        return out % self.n


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of text, which ends in its only smallest symbol, in order: ranks over doubled lengths."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (len(text) + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[0], (sorted_key[1:] != sorted_key[:-1]).cumsum()])
        rank = np.empty_like(fresh)
        rank[order] = fresh
        if fresh[-1] == len(text) - 1 or step >= len(text):
            return order
        step *= 2


class Phrases:
    """The windows of a block of items, and the numbers of their words."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        windows: dict[tuple[str, ...], set[str]] = {}
        for item, text in items:
            words = WORD.findall(lower_ascii(text))
            for i in range(max(1, len(words) - width + 1) if words else 0):
                windows.setdefault(tuple(words[i : i + width]), set()).add(item)
        self.words = sorted({w for x in windows for w in x})
        number = {w: i + 1 for i, w in enumerate(self.words)}
        self.windows = list(windows)
        self.items = [sorted(windows[w]) for w in self.windows]
        self.least = min(map(len, self.windows), default=width)
        self.by_length = {}
        for n in sorted({len(w) for w in self.windows}):
            own = [i for i, w in enumerate(self.windows) if len(w) == n]
            self.by_length[n] = np.array(own), np.array([[number[w] for w in self.windows[i]] for i in own], np.int64)
        coded = [w.encode() for w in self.words]
        data = np.frombuffer(b"".join(coded), np.uint8)
        ends = np.cumsum([0, *map(len, coded)])
        keys = slice_hash(prefix_sums(BYTE_VALUES[data]), ends[:-1], ends[1:])
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], order + 1
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.keys >> np.uint64(48)] = True

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Word numbers, 0 for words of no item."""
        out = np.zeros(len(keys), np.int64)
        near = np.flatnonzero(self.maybe[keys >> np.uint64(48)])
        if len(near) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys[near]), len(self.keys) - 1)
            hit = self.keys[at] == keys[near]
            out[near[hit]] = self.numbers[at[hit]]
        return out


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the column's words in its bytes, words before each row, and the words' hashes."""
    data, offsets = byte_view(column)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = IS_WORD[data]
    move = np.diff(inside)
    cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    cut = np.unique(cut[(inside[cut] == 1) & (inside[cut + 1] == 1)])  # words that touch across rows
    low = np.sort(np.concatenate([np.flatnonzero(move == 1), cut]))
    high = np.sort(np.concatenate([np.flatnonzero(move == -1), cut]))
    before = np.searchsorted(low, offsets)
    keys = slice_hash(prefix_sums(BYTE_VALUES[LOWER[data]]), low, high) if len(low) else np.zeros(0, np.uint64)
    return low, high, before, keys


def find(phrases: Phrases, column: pa.Array) -> tuple[np.ndarray, dict[int, list[int]], dict[int, set[str]]]:
    """Words of each row, and for rows with hits the merged word spans [start, end, ...] and the items found."""
    low, high, before, keys = words_of(column)
    counts = np.diff(before)
    spans: dict[int, list[int]] = {}
    items: dict[int, set[str]] = {}
    number = phrases.number(keys)
    row = np.repeat(np.arange(len(counts)), counts)
    # stretches of item words within a row that can hold a window
    known = number > 0
    edge = np.concatenate([[True], (row[1:] != row[:-1]) | (known[1:] != known[:-1])]) if len(row) else np.zeros(0, bool)
    begin = np.flatnonzero(edge)
    size = np.diff(np.append(begin, len(row)))
    keep = known[begin] & (size >= phrases.least) if len(begin) else np.zeros(0, bool)
    begin, size = begin[keep], size[keep]
    if not len(begin):
        return counts, spans, items
    total = size + 1  # a separator after each
    source = np.repeat(begin, total) + np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    text = number[np.minimum(source, len(number) - 1)]
    text[np.cumsum(total) - 1] = 0
    index = FMIndex(text)
    mark = np.zeros(len(number) + 1, np.int64)
    found_row, found_window = [], []
    for n, (own, symbols) in phrases.by_length.items():
        a, b = index.search(symbols)
        rows = np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
        if not len(rows):
            continue
        word, window = source[index.locate(rows)], np.repeat(own, b - a)
        np.add.at(mark, word, 1)
        np.add.at(mark, word + n, -1)
        found_row.append(row[word])
        found_window.append(window)
    if not found_row:
        return counts, spans, items
    pairs = np.unique(np.concatenate(found_row) * len(phrases.windows) + np.concatenate(found_window))
    for r, w in zip((pairs // len(phrases.windows)).tolist(), (pairs % len(phrases.windows)).tolist(), strict=True):
        items.setdefault(r, set()).update(phrases.items[w])
    hit = np.cumsum(mark[:-1]) > 0
    for r in items:
        flags = np.diff(hit[before[r] : before[r + 1]].astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        spans[r] = np.stack([np.flatnonzero(flags == 1), np.flatnonzero(flags == -1)], axis=1).ravel().tolist()
    return counts, spans, items


def merge(flat: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_parts(benchmark: DataFrame, width: int, part_words: int = 50_000) -> DataFrame:
    """(item, text): the words of each item, long items in parts that overlap so that each window lies in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_blocks(batches):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall(lower_ascii(text))
                parts = [" ".join(words[i : i + part_words + width - 1]) for i in range(0, max(1, len(words) - width + 1), part_words)] if words else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(parts, pa.string())], ["item", "text"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null")
    return items.mapInArrow(run, "item string, text string")


#: Makes a pass's output columns of the batch's own columns, the words of each row, its hits (word spans, flat) and its items.
Finish = Callable[[list[pa.Array], np.ndarray, list[list[int]], list[list[str]]], list[pa.Array]]


def searched(docs: DataFrame, benchmark: DataFrame, width: int, block_bytes: int, schema: StructType, finish: Finish) -> DataFrame:
    """docs (with a column text) against all windows of the benchmark, one block of it after the other.

    The driver holds one block, and the cluster one broadcast: between two blocks the hits so far are written down.
    """
    spark, columns = docs.sparkSession, docs.columns
    parts = item_parts(benchmark, width)
    total = parts.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    own = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    names = [free_name("_hits", columns), free_name("_items", columns)]
    carried = StructType([*docs.schema.fields, StructField(names[0], ArrayType(LongType())), StructField(names[1], ArrayType(StringType()))])
    now = docs
    for k in range(blocks):
        held = spark.sparkContext.broadcast(Phrases([(r["item"], r["text"]) for r in parts.where(own == k).collect()], width))
        last = k == blocks - 1

        def run(batches: Iterator[pa.RecordBatch], held=held, last=last, before=k > 0) -> Iterator[pa.RecordBatch]:
            for batch in arrow_blocks(batches, "text", SHARD_BYTES, trim=True):
                counts, spans, items = find(held.value, text_column(batch))
                own = batch.columns[: len(columns)]
                hits, got = [spans.get(i, []) for i in range(len(counts))], [sorted(items.get(i, ())) for i in range(len(counts))]
                if before:
                    hits = [[*old, *new] for old, new in zip(batch.column(len(columns)).to_pylist(), hits, strict=True)]
                    got = [sorted({*old, *new}) for old, new in zip(batch.column(len(columns) + 1).to_pylist(), got, strict=True)]
                made = finish(own, counts, hits, got) if last else [*own, pa.array(hits, pa.list_(pa.int64())), pa.array(got, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(made, (schema if last else carried).names)

        now = map_arrow(now, run, schema if last else carried)
        if not last:
            now = stored(now, "hits")
            held.destroy()
    return now


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs (doc_id, text)."""

    def finish(own: list[pa.Array], counts: np.ndarray, hits: list[list[int]], items: list[list[str]]) -> list[pa.Array]:
        n_hit = [sum(b - a for a, b in merge(x)) for x in hits]
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        return [own[0], pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())]

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = StructType.fromDDL("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    return searched(own, benchmark, width, block_bytes, schema, finish)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the characters from each span's first word to its last, the blanks after them included."""
    places = [m.span() for m in WORD.finditer(lower_ascii(text))]
    out, low = [], 0
    for a, b in spans:
        out.append(text[low : places[a][0]])
        low = places[b][0] if b < len(places) else places[b - 1][1]
    return "".join([*out, text[low:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """docs with the removal spans cut out of text; rows without a hit are unchanged."""
    at = docs.columns.index("text")

    def finish(own: list[pa.Array], counts: np.ndarray, hits: list[list[int]], items: list[list[str]]) -> list[pa.Array]:
        own = list(own)
        if any(hits):
            own[at] = pa.array([without(t, merge(h)) if h else t for t, h in zip(own[at].to_pylist(), hits, strict=True)], own[at].type)
        return own

    return searched(docs, benchmark, width, block_bytes, docs.schema, finish)
