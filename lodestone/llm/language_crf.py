"""Language ID: a linear-chain conditional random field over words.

A word is a maximal run of letters; its features are character bigrams and trigrams (those that touch the word's
edge are its short affixes), longer prefixes and suffixes, and the whole word as lexicon entry, all hashed into
one table of weights. Learned transitions tie neighbouring words, so code-switched texts get a label for each
stretch. Forward-backward gives each word's marginals; a document's label has the largest sum of them and its
score is that sum's share. A text's words are worked on in chains of ``CHAIN`` side by side, and messages pass
between them, so the marginals are those of the whole text in one chain.

The field is fitted on a bounded sample: at most ``per_language`` documents of each language value among the
labelled rows whose crc32(doc_id as text) mod 4 is not 2, the lowest by a hash, for at most ``languages`` values, the most
frequent ones (equal counts: by value). Everything else sees all words of all texts. Of labels with equal sums the
first in sorted order is taken. Null text, or no letters: ``und``, score 0. No labelled rows: every text is ``und``. A null doc_id
is never held out and never learned from. Repeated rows are labelled each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_blocks, map_arrow, text_column

BITS, CHAIN = 16, 48
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.uint32(2654435761)


@dataclass
class Field:
    """labels, hashed feature weights (4 << BITS, labels), transitions and start scores."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray


def _fold(key: np.ndarray, kind: int) -> np.ndarray:
    return ((key * _MIX) >> np.uint32(32 - BITS)) + np.uint32(kind << BITS)


def word_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram features by byte with the words' (low, high) slices of them, three features of each word, and words before each text."""
    coded = [x.lower().encode() for x in texts]
    raw = np.frombuffer(b"  " + b"  ".join(coded) + b"   ", np.uint8)
    lower = (raw >= 97) & (raw <= 122) | (raw >= 128)
    b = np.where(lower, raw, 32).astype(np.uint32)
    edge = np.diff(lower.astype(np.int8), prepend=np.int8(0))
    low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    starts = np.cumsum([2, *(len(x) + 2 for x in coded)])
    before = np.searchsorted(low, starts)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    grams = np.empty((2, len(raw)), np.uint32)
    grams[0, 1:], grams[1, 1:-1] = _fold(two, 0), _fold(three, 1)
    grams[0, 0], grams[1, 0], grams[1, -1] = 0, 0, 0
    spell = np.cumsum((b + np.uint32(1)) * _MIX ^ np.uint32(0x9E37), dtype=np.uint32)
    place = np.cumsum(spell, dtype=np.uint32)
    lexicon = (spell[high - 1] - spell[low - 1]) ^ (place[high - 1] - place[low - 1] - spell[low - 1] * (high - low).astype(np.uint32)) * np.uint32(97)
    ahead = np.minimum(low + 2, high)
    prefix = three[low - 1] * np.uint32(31) + b[np.minimum(ahead, len(b) - 1)]
    suffix = (b[np.maximum(high - 3, 0)] << np.uint32(24)) + three[high - 2]
    words = np.stack([_fold(prefix, 2), _fold(suffix * np.uint32(7), 2), _fold(lexicon, 3)])
    return grams, low, high, words, before


def scores(field: Field, grams: np.ndarray, low: np.ndarray, high: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(words, labels) feature scores; the grams count by their mean, so long words don't drown their neighbours."""
    if not len(low):
        return np.zeros((0, len(field.labels)), np.float32)
    by_byte = field.weights[grams[0]] + field.weights[grams[1]]
    # sums over low..high inclusive: the byte after a word closes its last grams
    sums = np.add.reduceat(by_byte, np.stack([low, np.minimum(high + 1, len(by_byte) - 1)], axis=1).ravel(), axis=0)[::2]
    out = sums / np.sqrt(high - low + 1)[:, None].astype(np.float32)
    for w in words:
        out += field.weights[w]
    return out


def chains(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts each text's words into chains of at most CHAIN: their first words, lengths, texts and numbers in them."""
    counts = np.diff(before)
    pieces = -(-counts // CHAIN)
    text = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = before[text] + nth * CHAIN
    return first, np.minimum(CHAIN, before[text + 1] - first), text, nth


def placed(emit: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, chain, label) factors of chains of words, each word's largest 1, and the mask of places that have a word."""
    steps = np.arange(int(size.max(initial=1)))[:, None]
    mask = steps < size[None, :]
    e = emit[np.minimum(first[None, :] + steps, max(len(emit) - 1, 0))]
    e = np.exp(e - e.max(axis=2, keepdims=True))
    e[~mask] = 1
    return e, mask


def messages(field: Field, e: np.ndarray, mask: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters each chain from the words before it in its text, and what comes back from those after it.

    nth: each chain's number in its text, whose chains follow one another. A chain is a product of matrices, so the
    chains' products are made all at once, and then only one vector for each text passes from chain to chain.
    """
    steps, n, k = e.shape
    go = np.exp(field.moves)
    whole = np.eye(k, dtype=np.float32)[None] * e[0][:, None, :]
    for t in range(1, steps):
        now = (whole @ go) * e[t][:, None, :]
        now /= now.max(axis=(1, 2), keepdims=True)
        whole = np.where(mask[t][:, None, None], now, whole)
    enter, leave = np.tile(np.exp(field.start), (n, 1)).astype(np.float32), np.ones((n, k), np.float32)
    order = np.argsort(nth, kind="stable")
    cuts = np.searchsorted(nth[order], np.arange(1, int(nth.max(initial=0)) + 2))
    rounds = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]  # second chains, third chains, ...
    for own in rounds:
        now = np.maximum((enter[own - 1][:, None, :] @ whole[own - 1])[:, 0] @ go, 1e-30)
        enter[own] = now / now.sum(axis=1, keepdims=True)
    for own in reversed(rounds):
        now = np.maximum((whole[own] @ leave[own][:, :, None])[:, :, 0] @ go.T, 1e-30)
        leave[own - 1] = now / now.max(axis=1, keepdims=True)
    return enter, leave


def forward_backward(field: Field, e: np.ndarray, mask: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (place, chain, label), expected moves and start marginals of chains of words with the given messages."""
    steps, n, k = e.shape
    a, go = np.empty((steps, n, k), np.float32), np.exp(field.moves)
    now = (np.exp(field.start)[None, :] if enter is None else enter) * e[0]
    a[0] = now / now.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        now = (a[t - 1] @ go) * e[t]
        now /= now.sum(axis=1, keepdims=True)
        a[t] = np.where(mask[t][:, None], now, a[t - 1])
    b, pairs = np.ones((n, k), np.float32) if leave is None else leave, np.zeros((k, k))
    out = np.empty_like(a)
    out[-1] = a[-1] * b
    out[-1] /= out[-1].sum(axis=1, keepdims=True)
    for t in range(steps - 1, 0, -1):
        ahead = e[t] * b
        joint = np.einsum("ni,nj->ij", a[t - 1] * mask[t][:, None] / np.maximum(((a[t - 1] @ go) * ahead).sum(axis=1, keepdims=True), 1e-30), ahead)
        pairs += joint * go
        back = ahead @ go.T
        back /= back.max(axis=1, keepdims=True)
        b = np.where(mask[t][:, None], back, b)
        post = a[t - 1] * b
        out[t - 1] = post / post.sum(axis=1, keepdims=True)
    return out, pairs, out[0].sum(axis=0)


def fit(labels: list[str], texts: list[str], gold: list[int], epochs: int = 3, batch: int = 24, rate: float = 0.3, seed: int = 7) -> Field:
    """Adagrad on the chains' log-likelihood. A third of the chains end in a chain of another text: code switches."""
    k, rng = len(labels), np.random.default_rng(seed)
    field = Field(labels, np.zeros((4 << BITS, k), np.float32), np.eye(k, dtype=np.float32) * 2, np.zeros(k, np.float32))
    sums = [np.full(x.shape, 0.1, np.float32) for x in (field.weights, field.moves, field.start)]
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            grams, low, high, words, before = word_features([texts[i] for i in chosen])
            if not len(low):
                continue
            truth = np.repeat(np.array([gold[i] for i in chosen]), np.diff(before))
            first, size, _, _ = chains(before)
            # where each place of a chain takes its word from: another chain of the batch beyond a random cut
            steps = int(size.max())
            source = first[None, :] + np.arange(steps)[:, None]
            other = rng.permutation(len(first))
            cut = np.where(rng.random(len(first)) < 1 / 3, rng.integers(1, CHAIN, len(first)), steps)
            late = (np.arange(steps)[:, None] >= cut[None, :]) & (np.arange(steps)[:, None] < np.minimum(size, size[other])[None, :])
            source = np.where(late, first[other][None, :] + np.arange(steps)[:, None], source)
            mask = np.arange(steps)[:, None] < size[None, :]
            source = np.minimum(source, len(low) - 1)
            emit = scores(field, grams, low, high, words)
            flat = emit[source.T.ravel()]
            post, pairs, begin = forward_backward(field, *placed(flat, np.arange(len(first)) * steps, size))
            want = np.zeros_like(post)
            np.put_along_axis(want, truth[source][:, :, None], 1, axis=2)
            error = (want - post) * mask[:, :, None]
            by_word = np.zeros_like(emit)
            for j in range(k):
                by_word[:, j] = np.bincount(source.ravel(), error[:, :, j].ravel(), len(low))
            total = float(mask.sum())
            gold_pairs = np.zeros((k, k))
            np.add.at(gold_pairs, (truth[source[:-1]][mask[1:]], truth[source[1:]][mask[1:]]), 1)
            sizes = high - low + 1
            span = np.repeat(np.arange(len(low)), sizes)
            byte = np.repeat(low, sizes) + np.arange(len(span)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            scaled = (by_word / np.sqrt(sizes)[:, None])[span]
            step = np.zeros_like(field.weights)
            for j in range(k):
                step[:, j] = sum(np.bincount(g, w, len(step)) for g, w in [(grams[0][byte], scaled[:, j]), (grams[1][byte], scaled[:, j]), *((w, by_word[:, j]) for w in words)])
            moved = (step / np.sqrt(total), (gold_pairs - pairs) / np.sqrt(total), (np.bincount(truth[source[0]], minlength=k) - begin) / np.sqrt(total))
            for value, gradient, held in zip((field.weights, field.moves, field.start), moved, sums, strict=True):
                gradient = gradient - 1e-3 * value
                held += gradient * gradient
                value += rate * gradient / np.sqrt(held)
    return field


def predict(field: Field | None, texts: list[str]) -> tuple[list[str], list[float]]:
    if field is None or not texts:
        return [UND] * len(texts), [0.0] * len(texts)
    grams, low, high, words, before = word_features(texts)
    totals = np.zeros((len(texts), len(field.labels)))
    if len(low):
        first, size, text, nth = chains(before)
        e, mask = placed(scores(field, grams, low, high, words), first, size)
        post, _, _ = forward_backward(field, e, mask, *messages(field, e, mask, nth))
        np.add.at(totals, text, (post * mask[:, :, None]).sum(axis=0, dtype=np.float64))
    best = totals.argmax(axis=1)
    share = totals[np.arange(len(texts)), best] / np.maximum(totals.sum(axis=1), 1e-9)
    named = [bool(_LETTER.search(x)) and totals[i].sum() > 0 for i, x in enumerate(texts)]
    return [field.labels[j] if ok else UND for j, ok in zip(best, named, strict=True)], [round(min(1.0, float(s)), 6) if ok else 0.0 for s, ok in zip(share, named, strict=True)]


def remainder(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 4


def learn(docs: DataFrame, per_language: int = 250, languages: int = 64) -> Field | None:
    """The field fitted on at most per_language documents of each of the most frequent languages."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (remainder() != 2))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return None
    # the hash share that gives about per_language rows of each language, then an exact bound
    share = F.create_map(*(x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, 1.2 * per_language / n)))))
    order = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    near = known.select("doc_id", "text", "lang", order.alias("h")).where(F.col("h") < share[F.col("lang")] * (1 << 30))
    rows = sorted((r["lang"], r["h"], r["text"]) for r in near.limit(2 * per_language * len(counts)).collect())
    labels = sorted(counts)
    taken: dict[str, int] = {}
    texts, gold = [], []
    for lang, _, text in rows:
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= per_language:
            texts.append(text)
            gold.append(labels.index(lang))
    return fit(labels, texts, gold) if texts else None


def identify(docs: DataFrame, per_language: int = 250) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text, lang)."""
    spark = docs.sparkSession
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = spark.sparkContext.broadcast(learn(known, per_language))  # bounded: 4 << BITS weights a label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_blocks(batches):
            got = predict(model.value, text_column(batch).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got[0], pa.string()), pa.array(got[1], pa.float64())], ["doc_id", "lang_pred", "score"])

    out = known.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.35, per_language: int = 250) -> DataFrame:
    """The rows of docs whose language is known with at least that share: und and texts of evenly mixed labels go."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, per_language))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_blocks(batches, trim=True):
            labels, shares = predict(model.value, [t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([label != UND and share >= least for label, share in zip(labels, shares, strict=True)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
