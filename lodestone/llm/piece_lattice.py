"""SentencePiece encoding and decoding by N-best search over the piece lattice.

A text is normalised as the model file's identity rule does: a space in front, spaces as U+2581. No piece runs
from another character into U+2581, so a text falls into independent segments (blanks, then what follows).

A BPE model's scores are merge ranks, and the sum of ranks along a path isn't what the library maximises. So each
segment's lattice is priced by its merges: an edge that merge order makes costs nothing, any other costs one more
than the distance of its piece's score from the model's best. The library's segmentation is then the only path of
cost 0, and the next best are those that leave it by the least sum of prices. A forward Viterbi pass gives every
position its least cost; those costs are exact heuristics for an A-star search backward from the end, which yields
segmentations in the order of their costs (equal ones in any fixed order). The texts' N best are put together from
the segments' own: only the segments with the N - 1 least second-best costs can differ from the best.

Merges, the forward pass and the second-best costs run over thousands of new segments at once in numpy; the search
itself only in the segments of a text that can take part in its N best. Solved segments are kept in arrays of
bounded size and compared by all their characters, not by hash alone. Long texts are handled in stretches that end
between segments; segments of over LONGEST characters are merged one by one by the same rule.

A character that no piece holds is written as byte pieces. Null or empty text: no pieces, one segmentation of cost
0. Repeated rows are encoded each. Texts that hold U+2581 decode with spaces in its place, as the library does; all
others decode to themselves. Other columns are not read, or, by ``encode``, pass through; a column ``pieces`` that
is already there keeps its name, and the new one takes underscores until its name is free.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_blocks, free_name, map_arrow, text_column
from lodestone.llm.rolling import mix, prefix_sums, slice_hash

BLANK = "▁"
BOUNDARY = re.compile(f"[^{BLANK}]{BLANK}")
#: Bytes of text handled at once, characters of a stretch, of a segment solved in numpy, and segments solved at once.
BLOCK, STRETCH, LONGEST, SOLVED = 1 << 20, 1 << 20, 40, 8192
#: Bytes of solved segments kept by a Python worker, and searched segments.
KEPT_BYTES, SEARCHED = 12 << 20, 20_000
_BASE = np.uint64(0xD6E8FEB86659FD93)
_loaded: dict[tuple[str, int], "Pieces"] = {}


def spread(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all slices that begin at low, one after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(low - (ends - size), size)


def values_of(codes: np.ndarray, turn: int = 0) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(0x9E3779B9 + turn))


class Ragged:
    """Rows of different lengths in one array that grows by doubling."""

    def __init__(self, kind):
        self.flat, self.ends, self.rows = np.zeros(1 << 12, kind), np.zeros(1 << 10, np.int64), 0

    def append(self, flat: np.ndarray, size: np.ndarray) -> None:
        begin = int(self.ends[self.rows - 1]) if self.rows else 0
        ends = begin + np.cumsum(size)
        self.flat, self.ends = self._room(self.flat, begin + len(flat)), self._room(self.ends, self.rows + len(size))
        self.flat[begin : begin + len(flat)] = flat
        self.ends[self.rows : self.rows + len(size)] = ends
        self.rows += len(size)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = self.ends[rows]
        low = np.where(rows > 0, self.ends[rows - 1], 0)
        return low, high - low

    def used(self) -> int:
        return int(self.ends[self.rows - 1]) * self.flat.itemsize if self.rows else 0

    def row(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i - 1] if i else 0 : self.ends[i]]


class Pieces:
    """A model's pieces and scores, with the segments solved most lately. best: how many segmentations are asked for."""

    def __init__(self, path: str, best: int):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.get_piece_size())
        self.name = [model.id_to_piece(i) for i in size]
        plain = [i for i in size if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {self.name[i]: (model.get_score(i), i) for i in plain}
        self.byte = {int(self.name[i][1:-1], 16): i for i in size if model.is_byte(i)}
        self.longest = max((len(p) for p in self.score), default=1)
        self.unknown, self.unknown_score = model.unk_id(), min((s for s, _ in self.score.values()), default=0.0) - 10
        self.top = max((s for s, _ in self.score.values()), default=0.0)
        spelled = {i: self.name[i].replace(BLANK, " ").encode() for i in plain} | {i: bytes([b]) for b, i in self.byte.items()}
        self.raw = [spelled.get(i, b"") for i in size]
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_size = np.array([len(x) for x in self.raw], np.int64)
        self.raw_low = np.cumsum(self.raw_size) - self.raw_size
        self.best = best
        # pieces by the hash of their characters, and a table that rules most others out
        named = sorted(self.score)
        keys = np.array([self._key(n) for n in named], np.uint64)
        order = np.argsort(keys)
        self.piece_keys, self.ids_by_key = keys[order], np.array([self.score[n][1] for n in named], np.int32)[order]
        cell = self.piece_keys >> np.uint64(46)
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[cell] = True
        # the first piece of each cell, and how many a cell has at most
        self.first_in = np.searchsorted(cell, np.arange(1 << 18, dtype=np.uint64)).astype(np.int32)
        self.crowd = int(np.unique(cell, return_counts=True)[1].max()) if len(cell) else 0
        # by id, the last for none: the rank by which pairs merge, and the price of an edge
        self.rank, self.price = np.full(len(self.name) + 1, np.inf), np.full(len(self.name) + 1, np.inf)
        self.scores = np.zeros(len(self.name) + 1)
        for score, i in self.score.values():
            self.rank[i], self.price[i], self.scores[i] = -score, self.top - score + 1, score
        # combinations of ranks over segments that the N best can take: a combination has product(rank + 1) no worse ones
        self.ways = [w for w in product(range(best), repeat=best - 1) if np.prod(np.array(w, np.int64) + 1) <= best]
        self.forget()

    @staticmethod
    def _key(piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for v in values_of(np.array([ord(c) for c in piece], np.uint32)):
            h = h * _BASE + v
        return mix(h)[0]

    def forget(self) -> None:
        """Empties the store of solved segments."""
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.codes, self.ids, self.loss, self.total = Ragged(np.uint32), Ragged(np.int32), Ragged(np.float32), Ragged(np.float64)
        self.searched: dict[int, list[tuple[float, np.ndarray]]] = {}

    # Merge order

    def _piece(self, keys: np.ndarray) -> np.ndarray:
        """The ids of pieces with these keys, -1 for none."""
        out = np.full(len(keys), -1, np.int32)
        cell = (keys >> np.uint64(46)).astype(np.int32)
        near = np.flatnonzero(self.maybe[cell])
        keys, at = keys[near], self.first_in[cell[near]]
        for _ in range(self.crowd):
            found = self.piece_keys[at]
            hit = found == keys
            out[near[hit]] = self.ids_by_key[at[hit]]
            left = np.flatnonzero(found < keys)
            near, keys, at = near[left], keys[left], np.minimum(at[left] + 1, len(self.piece_keys) - 1)
        return out

    def solve(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids (flat), their number, the second-best cost and the sum of scores of segments of at most LONGEST characters."""
        n, top = len(size), int(size.max())
        wide = min(self.longest, top)
        letters = np.zeros((top, n), np.uint32)  # position by segment
        low = np.cumsum(size) - size
        column = np.repeat(np.arange(n), size)
        letters[np.arange(len(codes)) - low[column], column] = codes
        inside = np.arange(top)[:, None] < size[None, :]
        values = values_of(letters)
        piece = np.full((wide + 1, top + 1, n), -1, np.int32)  # by length and first character
        h = np.zeros((top + 1, n), np.uint64)
        for k in range(1, wide + 1):
            h = h[: top - k + 1] * _BASE + values[k - 1 :]
            at = np.flatnonzero(inside[k - 1 :])
            piece[k, : top - k + 1].reshape(-1)[at] = self._piece(mix(h.reshape(-1)[at]))
        made = self._merged(piece, inside, size)
        second = self._second(piece, made, inside, size) if self.best > 1 else np.full(n, np.inf)
        # pieces in text order; an unknown character gives its bytes
        seg, first = np.nonzero(made.T)
        ids = piece[made[first, seg], first, seg]
        count = np.ones(len(ids), np.int64)
        strange = np.flatnonzero(ids < 0)
        spelled = [self._spelled(c) for c in letters[first[strange], seg[strange]].tolist()]
        count[strange] = [len(x) for x in spelled]
        flat = np.repeat(ids, count)
        if len(strange):
            flat[flat < 0] = np.concatenate([np.array(x, np.int32) for x in spelled])
        sums = np.bincount(seg, np.where(ids < 0, self.unknown_score, self.scores[ids]), n)
        return flat, np.bincount(seg, count, n).astype(np.int64), second, sums

    def _spelled(self, code: int) -> list[int]:
        return [self.byte.get(b, self.unknown) for b in chr(code).encode()] if self.byte else [self.unknown]

    def _merged(self, piece: np.ndarray, inside: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The lengths of the symbols that begin at each position (0: none) when no pair is left to merge.

        In each round every segment joins its pair of the least rank, the leftmost of equals, as the library does.
        """
        wide, top, n = len(piece) - 1, len(inside), len(size)
        length = inside.astype(np.int64)
        before = np.arange(-1, top)[:, None] + np.zeros(n, np.int64)  # the start of the symbol before
        pair = np.full((top + 1, n), np.inf)
        if wide > 1:
            pair[: top - 1] = self.rank[piece[2, : top - 1]]
        rows = np.arange(n)
        while len(rows):
            at = pair[:, rows].argmin(axis=0)
            going = pair[at, rows] < np.inf
            rows, at = rows[going], at[going]
            if not len(rows):
                break
            gone = at + length[at, rows]
            both = length[at, rows] + length[gone, rows]
            length[at, rows], length[gone, rows], pair[gone, rows] = both, 0, np.inf
            after = at + both
            has = after < size[rows]
            before[np.where(has, after, top), rows] = at
            total = both + np.where(has, length[np.minimum(after, top - 1), rows], 0)
            fits = has & (total <= wide)
            pair[at, rows] = np.where(fits, self.rank[piece[np.where(fits, total, 0), at, rows]], np.inf)
            prior = before[at, rows]
            has = prior >= 0
            total = both + np.where(has, length[prior, rows], 0)
            fits = has & (total <= wide)
            now = np.where(fits, self.rank[piece[np.where(fits, total, 0), prior, rows]], np.inf)
            pair[prior[has], rows[has]] = now[has]
        return length

    def _second(self, piece: np.ndarray, made: np.ndarray, inside: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The costs of the second-best segmentations: the least over an edge that is not on the best path."""
        wide, top, n = len(piece) - 1, len(inside), len(size)
        price = self.price.astype(np.float32)
        cost = price[piece[:, :top]]
        unknown = np.float32(self.top - self.unknown_score + 1)
        cost[1][inside & (piece[1, :top] < 0)] = unknown
        free = np.zeros(cost.shape, bool)
        at, seg = np.nonzero(made)
        free[made[at, seg], at, seg] = True
        ahead, behind = np.full((top + 1, n), np.inf, np.float32), np.full((top + wide + 1, n), np.inf, np.float32)
        ahead[0] = 0
        behind[size, np.arange(n)] = 0
        toll = np.where(free, np.float32(0), cost)
        for p in range(1, top + 1):
            for k in range(1, min(p, wide) + 1):
                np.minimum(ahead[p], ahead[p - k] + toll[k, p - k], out=ahead[p])
        second = np.full(n, np.inf, np.float32)
        cost[free] = np.inf
        for p in range(top - 1, -1, -1):
            for k in range(1, min(wide, top - p) + 1):
                np.minimum(behind[p], toll[k, p] + behind[p + k], out=behind[p])
                np.minimum(second, ahead[p] + cost[k, p] + behind[p + k], out=second)
        return second

    def merged(self, segment: str) -> list[int]:
        """The lengths of a segment's symbols in merge order, for segments of any length."""
        n, known = len(segment), self.score
        size, before = [1] * n, list(range(-1, n - 1))

        def offer(a: int) -> None:
            b = a + size[a]
            if b < n and (got := known.get(segment[a : b + size[b]])):
                heapq.heappush(heap, (-got[0], a, size[a], size[b]))

        heap: list[tuple[float, int, int, int]] = []
        for i in range(n):
            offer(i)
        while heap:
            _, a, left, right = heapq.heappop(heap)
            b = a + left
            if size[a] != left or size[b] != right:
                continue
            size[a], size[b] = left + right, 0
            if a + size[a] < n:
                before[a + size[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [k for k in size if k]

    # Search

    def lattice(self, segment: str) -> tuple[list[list[tuple[int, float, int]]], list[float]]:
        """For each position the pieces that end there as (start, cost, id, or below 0 for an unknown character), and its least cost."""
        n, known, longest = len(segment), self.score, self.longest
        made = set()
        at = 0
        for k in self.merged(segment):
            made.add((at, at + k))
            at += k
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        least = [0.0] + [float("inf")] * n
        for j in range(1, n + 1):
            own = ends[j]
            for i in range(max(0, j - longest), j):
                if got := known.get(segment[i:j]):
                    own.append((i, 0.0 if (i, j) in made else self.top - got[0] + 1, got[1]))
            if segment[j - 1] not in known:
                own.append((j - 1, 0.0 if (j - 1, j) in made else self.top - self.unknown_score + 1, -1))
            least[j] = min(least[i] + s for i, s, _ in own)
        return ends, least

    def search(self, segment: str, count: int) -> list[tuple[float, list[tuple[int, int]]]]:
        """The count best segmentations as (cost, [(start, id), ...]), the best first."""
        ends, least = self.lattice(segment)
        # (cost so far + exact cost of the rest, position, order of entry, cost so far, (start, id, what follows))
        heap: list[tuple[float, int, int, float, tuple | None]] = [(least[-1], len(segment), 0, 0.0, None)]
        out, entered = [], 0
        while heap and len(out) < count:
            _, j, _, done, after = heapq.heappop(heap)
            if j == 0:
                path = []
                while after:
                    path.append(after[:2])
                    after = after[2]
                out.append((done, path))
                continue
            for i, s, piece in ends[j]:
                entered += 1
                heapq.heappush(heap, (done + s + least[i], i, entered, done + s, (i, piece, after)))
        return out

    def path_ids(self, segment: str, path: list[tuple[int, int]]) -> list[int]:
        return [x for start, piece in path for x in ([piece] if piece >= 0 else self._spelled(ord(segment[start])))]

    def ranking(self, slot: int) -> list[tuple[float, np.ndarray]]:
        """A solved segment's best segmentations as (cost, ids)."""
        got = self.searched.get(slot)
        if got is None:
            segment = self.codes.row(slot).tobytes().decode("utf-32-le")
            got = [(cost, np.array(self.path_ids(segment, path), np.int32)) for cost, path in self.search(segment, self.best)]
            if len(self.searched) >= SEARCHED:
                self.searched.clear()
            if len(segment) <= LONGEST:
                self.searched[slot] = got
        return got

    # Texts

    def _solved(self, codes: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Puts segments into the store and gives their slots."""
        order = np.argsort(size, kind="stable")
        slots = np.empty(len(size), np.int64)
        short = order[: np.searchsorted(size[order], LONGEST, side="right")]
        for begin in range(0, len(short), SOLVED):
            own = short[begin : begin + SOLVED]
            flat = codes[spread(low[own], size[own])]
            ids, count, second, total = self.solve(flat, size[own])
            slots[own] = self.codes.rows + np.arange(len(own))
            self._keep(flat, size[own], ids, count, second, total)
        for i in order[len(short) :].tolist():
            flat = codes[low[i] : low[i] + size[i]]
            segment = flat.tobytes().decode("utf-32-le")
            at, path = 0, []
            for k in self.merged(segment):
                path.append((at, self.score.get(segment[at : at + k], (0, -1))[1]))
                at += k
            ids = np.array(self.path_ids(segment, path), np.int32)
            found = self.search(segment, 2) if self.best > 1 else []
            second = np.array([found[1][0] if len(found) > 1 else np.inf])
            slots[i] = self.codes.rows
            self._keep(flat, np.array([len(flat)]), ids, np.array([len(ids)]), second, np.array([sum(self.scores[p] if p >= 0 else self.unknown_score for _, p in path)]))
        return slots

    def _keep(self, codes, size, ids, count, second, total) -> None:
        one = np.ones(len(size), np.int64)
        self.codes.append(codes, size)
        self.ids.append(ids, count)
        self.loss.append(second, one)
        self.total.append(total, one)

    def slots_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The slots of the segments of normalised stretches of text, and the number of each stretch's segments."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        begin = np.cumsum([0, *map(len, texts)])[:-1]
        blank = codes == ord(BLANK)
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[begin] = True
        low = np.flatnonzero(first)
        size = np.diff(np.append(low, len(codes)))
        number = np.diff(np.append(np.searchsorted(low, begin), len(low)))
        turn = 0
        while True:
            keys = slice_hash(prefix_sums(values_of(codes, turn)), low, low + size)
            every, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
            same = (size == size[where][inverse]).all() and np.array_equal(codes, codes[spread(low[where][inverse], size)])
            if same:
                break
            turn += 1  # two segments with one key: other keys
        low, size = low[where], size[where]
        slots = np.full(len(every), -1, np.int64)
        if len(self.keys) and not turn:
            at = np.minimum(np.searchsorted(self.keys, every), len(self.keys) - 1)
            met = np.flatnonzero(self.keys[at] == every)
            held = self.slots[at[met]]
            begin, length = self.codes.bounds(held)
            met, held, begin = (x[length == size[met]] for x in (met, held, begin))
            differ = codes[spread(low[met], size[met])] != self.codes.flat[spread(begin, size[met])]
            equal = np.add.reduceat(differ, np.cumsum(size[met]) - size[met]) == 0 if len(met) else np.zeros(0, bool)
            slots[met[equal]] = held[equal]
        fresh = np.flatnonzero(slots < 0)
        if len(fresh):
            slots[fresh] = self._solved(codes, low[fresh], size[fresh])
            if not turn:
                new = fresh[np.flatnonzero(~np.isin(every[fresh], self.keys))]
                place = np.searchsorted(self.keys, every[new])
                self.keys, self.slots = np.insert(self.keys, place, every[new]), np.insert(self.slots, place, slots[new])
        return slots[inverse], number

    def stretches(self, texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
        """Normalised texts in blocks of about STRETCH characters, longer ones cut between segments, with each one's text."""
        held, owner, total = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            text, low = BLANK + text.replace(" ", BLANK), 0
            while low < len(text):
                high = len(text)
                if high - low > STRETCH and (cut := BOUNDARY.search(text, low + STRETCH)):
                    high = cut.start() + 1
                if held and total + high - low > STRETCH:
                    yield held, owner
                    held, owner, total = [], [], 0
                held.append(text[low:high])
                owner.append(i)
                total += high - low
                low = high
        if held:
            yield held, owner

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts (flat) and their number for each text; slots of all segments (flat) and their number.

        The slots hold until the next call.
        """
        if self.codes.rows and self.codes.used() + self.ids.used() + 40 * self.codes.rows > KEPT_BYTES:
            self.forget()
        count, parts, ids, slots = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for held, owner in self.stretches(texts):
            own, number = self.slots_of(held)
            low, size = self.ids.bounds(own)
            ids.append(self.ids.flat[spread(low, size)])
            slots.append(own)
            np.add.at(parts, owner, number)
            np.add.at(count, owner, np.add.reduceat(size, np.cumsum(number) - number))
        return np.concatenate(ids), count, np.concatenate(slots), parts

    def nearest(self, slots: np.ndarray) -> list[tuple[float, list[tuple[int, np.ndarray]]]]:
        """The best segmentations of a text as (cost, [(segment, ids), ...]): the segments that differ from the best, which comes first."""
        loss = self.loss.flat[slots]
        near = np.arange(len(loss))
        if self.best > 1 and len(loss) >= self.best:
            near = np.flatnonzero(loss <= np.partition(loss, self.best - 2)[self.best - 2])
        near = near[np.argsort(loss[near], kind="stable")][: self.best - 1]
        near = [i for i in near.tolist() if loss[i] < np.inf]
        ranked = [self.ranking(int(slots[i])) for i in near]
        every = []
        for way in self.ways:
            if any(way[len(near) :]) or any(k >= len(r) for k, r in zip(way, ranked, strict=False)):
                continue
            every.append((sum(r[k][0] for k, r in zip(way, ranked, strict=False)), way))
        return [(cost, sorted((i, r[k][1]) for i, k, r in zip(near, way, ranked, strict=False) if k)) for cost, way in heapq.nsmallest(self.best, every)]

    def spelled_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, the space in front included."""
        return self.raw_flat[spread(self.raw_low[ids], self.raw_size[ids])].tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the space in front is dropped."""
        return b"".join([self.raw[i] for i in ids]).decode(errors="replace").removeprefix(" ")

    def replaced(self, ids: np.ndarray, slots: np.ndarray, changed: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """The ids of a text with those of some segments changed."""
        _, size = self.ids.bounds(slots)
        ends, out, low = np.cumsum(size), [], 0
        for i, own in changed:
            out += [ids[low : ends[i] - size[i]], own]
            low = ends[i]
        return np.concatenate([*out, ids[low:]])


def pieces(path: str, best: int) -> Pieces:
    """One per Python worker."""
    if (path, best) not in _loaded:
        _loaded[path, best] = Pieces(path, best)
    return _loaded[path, best]


def segmentations(docs: DataFrame, model_path: str, best: int = 4) -> DataFrame:
    """The best segmentation of each text and the next ones.

    doc_id, n_pieces, score (the sum of the model's scores), ids_sha256 (of little-endian 32-bit ids), n_best, and of
    the others next_costs and next_sha256 (comma-joined); decoded_same: the ids spell the text.
    """
    kinds = {"n_pieces": pa.int64(), "score": pa.float64(), "ids_sha256": pa.string(), "n_best": pa.int64(), "next_costs": pa.string(), "next_sha256": pa.string(), "decoded_same": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path, best)
        for batch in arrow_blocks(batches, "text", BLOCK):
            texts = text_column(batch).to_pylist()
            ids, count, slots, parts = model.encoded(texts)
            rows = []
            for text, high, n, end, m in zip(texts, np.cumsum(count).tolist(), count.tolist(), np.cumsum(parts).tolist(), parts.tolist(), strict=True):
                own, places = ids[high - n : high], slots[end - m : end]
                found = model.nearest(places)
                others = [hashlib.sha256(model.replaced(own, places, changed)).hexdigest() for _, changed in found[1:]]
                same = model.spelled_bytes(own)[1:] == text.encode()
                rows.append((n, float(model.total.flat[places].sum()), hashlib.sha256(own).hexdigest(), len(found), ",".join(f"{x:.0f}" for x, _ in found[1:]), ",".join(others), same))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True))], ["doc_id", *kinds])

    schema = "doc_id long, n_pieces long, score double, ids_sha256 string, n_best long, next_costs string, next_sha256 string, decoded_same boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """docs with text replaced by pieces, the ids of the best segmentation."""
    at = docs.columns.index("text")
    new = free_name("pieces", docs.columns)
    names = [new if c == "text" else c for c in docs.columns]
    schema = docs.withColumn("text", F.array().cast("array<int>")).toDF(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path, 1)
        for batch in arrow_blocks(batches, "text", BLOCK, trim=True):
            ids, count, _, _ = model.encoded(text_column(batch).to_pylist())
            columns = list(batch.columns)
            columns[at] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(docs, run, schema)


def decode(encoded: DataFrame, model_path: str, column: str = "pieces") -> DataFrame:
    """encoded with the column of ids replaced by text; null pieces give an empty text."""
    at = encoded.columns.index(column)
    new = free_name("text", encoded.columns)
    names = [new if c == column else c for c in encoded.columns]
    schema = encoded.withColumn(column, F.lit("")).toDF(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path, 1)
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([model.decode(x or []) for x in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(encoded, run, schema)
