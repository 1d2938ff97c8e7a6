import random
from itertools import product

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import piece_lattice
from lodestone.llm.piece_lattice import BLANK, Pieces, decode, encode, segmentations

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "hello world", "  two  spaces ", "über\nçaé\t日本x", "the thonreinsh", "a\x00b", "ends ", "🙂 é", "x" * 90 + " " + BLANK + "q", " " * 40]


def odd_texts(n, seed=5):
    pick = random.Random(seed)
    pool = " \n\taeioubcdstrn" + BLANK + "éüñß日本語🙂\x00.,-0123456789THE"
    return ["".join(pick.choices(pool, k=pick.randint(1, 120))) for _ in range(n)]


def texts_of(model, texts):
    ids, count, slots, parts = model.encoded(texts)
    ends, stops = np.cumsum(count), np.cumsum(parts)
    return [(ids[e - n : e], slots[s - m : s]) for e, n, s, m in zip(ends, count, stops, parts, strict=True)]


def brute(model, segment):
    """All segmentations as (cost, ids), the costs from the library's own segmentation."""
    made, at = set(), 0
    for k in model.merged(segment):
        made.add((at, at + k))
        at += k

    def walk(low):
        if low == len(segment):
            return [(0.0, [])]
        out = []
        for high in range(low + 1, len(segment) + 1):
            piece = segment[low:high]
            score, i = model.score.get(piece, (model.unknown_score, -1))
            if i >= 0 or high == low + 1:
                cost = 0.0 if (low, high) in made else model.top - score + 1
                ids = [i] if i >= 0 else [model.byte[b] for b in piece.encode()]
                out += [(cost + rest, ids + tail) for rest, tail in walk(high)]
        return out

    return sorted(walk(0), key=lambda x: x[0])


def test_best_ids_are_the_librarys():
    model = Pieces(PATH, 2)
    real = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    for texts in (TEXTS, odd_texts(3000), real):
        for low in range(0, len(texts), 200):
            block = texts[low : low + 200]
            for text, (ids, _), want in zip(block, texts_of(model, block), model.model.encode(block), strict=True):
                assert ids.tolist() == want, text[:80]


def test_search_is_exact():
    model = Pieces(PATH, 6)
    for word in ("hello", BLANK + "theory", BLANK * 3 + "abc", "日本x", "über", "a\nb", BLANK + "thonrein"):
        want = brute(model, word)
        found = model.search(word, 6)
        assert [s for s, _ in found] == pytest.approx([s for s, _ in want[:6]])
        ids = [tuple(model.path_ids(word, path)) for _, path in found]
        assert len(set(ids)) == len(ids)
        assert list(ids[0]) == want[0][1]
        for own in ids:
            assert b"".join(model.raw[i] for i in own).decode() == word.replace(BLANK, " ")
    assert [s for s, _ in model.search(BLANK + "a", 2)][0] == 0


def test_solved_costs_match_search():
    model = Pieces(PATH, 4)
    words = "the thonreinsh erthly Éau schön a hello tokenization ééê x1y2 🙂 日本 und a\nb".split(" ")
    ((ids, slots),) = texts_of(model, [" ".join(words)])
    for word, slot in zip(words, slots, strict=True):
        found = model.search(BLANK + word, 2)
        assert found[0][0] == 0
        assert model.loss.flat[slot] == (pytest.approx(found[1][0]) if len(found) > 1 else np.inf)
        assert model.ids.row(slot).tolist() == model.path_ids(BLANK + word, found[0][1])


def test_whole_text_n_best():
    model = Pieces(PATH, 5)
    for text in ("the cat sat on", "a", "hi thonrein the the"):
        ((ids, slots),) = texts_of(model, [text])
        ways = [brute(model, BLANK + w) for w in text.split(" ")]
        every = sorted((sum(x[0] for x in way), [i for x in way for i in x[1]]) for way in product(*(w[:5] for w in ways)))
        found = [(cost, model.replaced(ids, slots, changed).tolist()) for cost, changed in model.nearest(slots)]
        assert [c for c, _ in found] == pytest.approx([c for c, _ in every[:5]])
        assert found[0][1] == ids.tolist()
        assert len({tuple(x) for _, x in found}) == len(found)
        for _, own in found:
            assert model.decode(own) == text


def test_long_texts_and_a_full_store(monkeypatch):
    texts = [t * 40 for t in odd_texts(60, 7)] + ["x" * 500, " " * 500, "", "ab cd " * 300]
    model = Pieces(PATH, 3)
    want = texts_of(model, texts)
    monkeypatch.setattr(piece_lattice, "STRETCH", 300)
    monkeypatch.setattr(piece_lattice, "KEPT_BYTES", 1000)
    monkeypatch.setattr(piece_lattice, "SOLVED", 7)
    small = Pieces(PATH, 3)
    for text, (ids, _) in zip(texts, want, strict=True):
        ((own, slots),) = texts_of(small, [text])
        assert own.tolist() == ids.tolist() == model.model.encode(text)
        assert small.nearest(slots)[0][0] == 0


def test_equal_keys_are_told_apart(monkeypatch):
    real = piece_lattice.slice_hash
    model = Pieces(PATH, 2)
    calls = []

    def weak(sums, low, high):
        calls.append(1)
        out = real(sums, low, high)
        return out % np.uint64(3) if len(calls) == 1 else out

    monkeypatch.setattr(piece_lattice, "slice_hash", weak)
    ((ids, _),) = texts_of(model, ["one two three four five"])
    assert ids.tolist() == model.model.encode("one two three four five")


def test_round_trip(spark):
    rows = [(i, t, i, "x", "own") for i, t in enumerate(TEXTS)] + [(None, None, 0, None, None), (2, TEXTS[2], 2, "x", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_pieces int, `a.b` string, Pieces string")
    encoded = encode(docs, PATH)
    assert encoded.columns == ["doc_id", "pieces_", "n_pieces", "a.b", "Pieces"]
    back = decode(encoded, PATH, "pieces_")
    assert back.columns == docs.columns
    want = docs.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), BLANK, " "))
    assert sorted(map(str, back.collect())) == sorted(map(str, want.collect()))
    rows = segmentations(docs, PATH).collect()
    assert all(r["decoded_same"] == (BLANK not in TEXTS[r["doc_id"] or 0]) for r in rows) and len(rows) == len(TEXTS) + 2
    assert {r["n_pieces"] for r in rows if r["doc_id"] in (0, None)} == {0}
    assert {len(r["next_sha256"].split(",")) for r in rows if r["n_best"] == 4} == {3}
    assert segmentations(docs.limit(0), PATH).count() == 0
    assert encode(docs.limit(0), PATH).count() == 0
