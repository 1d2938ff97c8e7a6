"""Suffix-array dedup: column-wise construction over many documents.

Windows of 200 bytes pick their least 32-byte gram as anchor (``repeats``); the records around one anchor are the
documents of the construction, aligned on it. Rounds go from the last column to the first. A round inserts one
symbol of each document: the stable order by symbol of the round before is the order of the suffixes that begin
here, the symbols read in the old order are the round's Burrows-Wheeler transform, and the common prefix of two
neighbours with equal symbols is one more than the least between their old places. Columns lie in a temporary
file that is written and read in sequence; memory holds one round. Two neighbours that share ``width`` symbols are
repeated strings.

Aligned documents need no comparison across columns: equal windows lie in equal columns of one anchor's records.

Null or empty text, and texts below ``width`` bytes: nothing is removed. Equal texts and rows repeat each other.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import byte_view
from lodestone.llm.repeats import Anchored, anchor_chunks, anchored, answered, by_anchor, covered, repeated
from lodestone.llm.rolling import BYTE_VALUES, first_minimum, gram_hashes, prefix_sums

GRAM = 32
CHUNK_BYTES = 4 << 20


def scan(column: pa.Array, width: int) -> tuple[Anchored, Callable[[int, int], bytes]]:
    data, offsets = byte_view(column)
    values = BYTE_VALUES[data]
    gram = min(GRAM, width)
    names = gram_hashes(prefix_sums(values), gram)
    return anchored(values, offsets, width, first_minimum(names, width - gram + 1), lambda at: (at, names[at])), lambda a, b: data[a : b - 1 + width].tobytes()


def columns_file(data: np.ndarray, offsets: np.ndarray, shift: np.ndarray, width: int):
    """A temporary file of columns, each with one symbol of each document (0: none), the last column first."""
    n, size = len(shift), np.diff(offsets)
    file = tempfile.TemporaryFile(prefix="columns-")
    for c in range(width - 1, -1, -1):
        place = c - shift
        here = (place >= 0) & (place < size)
        column = np.zeros(n, np.uint16)
        column[here] = data[offsets[:-1][here] + place[here]].astype(np.uint16) + 1
        column.tofile(file)
    file.seek(0)
    return file


def columnwise(data: np.ndarray, offsets: np.ndarray, shift: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each column from the last: its number, the documents in suffix order, their common prefixes with the one before, and the transform."""
    n = len(shift)
    total = int((shift + np.diff(offsets)).max(initial=0))
    order, common = np.arange(n), np.zeros(n + 1, np.int32)
    with columns_file(data, offsets, shift, total) as file:
        for c in range(total - 1, -1, -1):
            symbols = np.fromfile(file, np.uint16, n)
            transform = symbols[order]
            place = np.argsort(transform, kind="stable")
            order = order[place]
            after = np.zeros(n + 1, np.int32)
            if n > 1:
                same = (transform[place[1:]] == transform[place[:-1]]) & (transform[place[1:]] > 0)
                # the least common prefix between the old places of two neighbours
                between = np.minimum.reduceat(common, np.stack([place[:-1] + 1, place[1:] + 1], axis=1).ravel())[::2]
                after[1:n] = np.where(same, between + 1, 0)
            common = after
            yield c, order, common[:n], transform


def repeated_starts(data: np.ndarray, offsets: np.ndarray, off: np.ndarray, n: np.ndarray, width: int) -> list[np.ndarray]:
    """For each document, aligned on its place off and standing for n occurrences, the starts [from, to), flat, of repeated windows, counted from off."""
    size = np.diff(offsets)
    far = int(off.max(initial=0))
    shift = far - off
    total = int((shift + size).max(initial=0))
    flags = np.zeros((len(off), total + 2), np.int8)
    for c, order, common, _ in columnwise(data, offsets, shift):
        long = common >= width
        long[:-1] |= long[1:]
        flags[order[long], c + 1] = 1
        flags[(n > 1) & (shift <= c) & (c + width <= shift + size), c + 1] = 1
    row, place = np.nonzero(np.diff(flags, axis=1))  # pairs: where a stretch begins, and where it ends
    return np.split(place - far, np.searchsorted(row, np.arange(1, len(off)))) if len(off) else []


def resolver(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in anchor_chunks(batches, CHUNK_BYTES):
            data, offsets = byte_view(whole.column("data").combine_chunks())
            yield answered(whole, repeated_starts(data, offsets, whole.column("off").to_numpy(), whole.column("n").to_numpy(), width))

    return by_anchor(run)


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, low = [], 0
    for a, b in spans:
        out.append(text[low:a])
        low = b
    return b"".join([*out, text[low:]])


def suffix_dedup(docs: DataFrame, width: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs (doc_id, text)."""

    def finish(texts: list[bytes], starts: list[np.ndarray]) -> list[tuple]:
        out = []
        for text, own in zip(texts, starts, strict=True):
            spans = covered(own, width)
            kept = kept_bytes(text, spans)
            out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        return out

    return repeated(docs, lambda column: scan(column, width), width, resolver(width), finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", settled=False)
