import hashlib

import numpy as np
import pytest

from lodestone.llm.recompression import recompression_dedup
from lodestone.llm.suffix_dedup import columnwise, suffix_dedup


def brute_bytes(texts, width):
    seen = {}
    for t in texts:
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]] = seen.get(t[i : i + width], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def sample_texts(seed, words):
    rng = np.random.default_rng(seed)
    make = lambda n: " ".join(words[i] for i in rng.integers(0, len(words), n))
    passages = [make(n) for n in (40, 60, 80, 120)]
    texts = ["", "a", "é" * 300, "ab" * 260, "ab" * 200 + "c", make(5)]
    for i in range(60):
        parts = [make(rng.integers(0, 50)) for _ in range(3)]
        texts.append((" " if i % 2 else "\n").join([parts[0], passages[rng.integers(4)], parts[1], passages[rng.integers(4)][: rng.integers(10, 400)], parts[2]]))
    base = make(300)
    for _ in range(12):
        t = list(base)
        for j in rng.integers(0, len(t), 3):
            t[j] = "#"
        texts.append("".join(t))
    return [*texts, base, base, texts[9]]


WORDS = ["the", "of", "alpha", "beta", "gamma", "Étage", "x", "yy", "zebra", "q1", "delta-7"]


def test_columnwise_orders_suffixes():
    rng = np.random.default_rng(8)
    docs = [bytes(rng.integers(97, 99, rng.integers(1, 12)).tolist()) for _ in range(50)]
    data, offsets = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)])
    shift = rng.integers(0, 4, 50)
    for c, order, common, _ in columnwise(data, offsets, shift):
        suffix = [docs[i][max(c - shift[i], 0) :] if c >= shift[i] else b"" for i in order]
        for k in range(1, 50):
            a, b = suffix[k - 1], suffix[k]
            both = c >= shift[order[k]] and c >= shift[order[k - 1]] and a and b
            n = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
            assert common[k] == (n if both else 0)
            assert not both or a[n : n + 1] <= b[n : n + 1]


@pytest.mark.parametrize("dense", [4096, 1])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, dense):
    import lodestone.llm.repeats as repeats

    monkeypatch.setattr(repeats, "DENSE", dense)
    texts = sample_texts(9, WORDS)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "y"), (5, texts[5], "z")], "doc_id long, text string, h string")
    got = sorted((tuple(r) for r in suffix_dedup(docs, 200).collect()), key=str)
    every = [*texts, "", texts[5]]
    ids = [*range(len(texts)), None, 5]
    want = sorted(((i, *x) for i, x in zip(ids, brute_bytes([t.encode() for t in every], 200))), key=str)
    assert got == want
    assert suffix_dedup(docs.limit(0)).count() == 0


def brute_words(texts, width):
    import re

    every = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    seen = {}
    for w in every:
        for i in range(len(w) - width + 1):
            seen[tuple(w[i : i + width])] = seen.get(tuple(w[i : i + width]), 0) + 1
    out = []
    for w in every:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone |= {*range(i, i + width)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_symbols_in_reach_recur_in_equal_windows():
    from lodestone.llm.recompression import anchors, levels

    rng = np.random.default_rng(10)
    core = rng.integers(1, 4, 200).astype(np.uint64)
    core[50:90] = 2
    make = lambda n: rng.integers(1, 4, n).astype(np.uint64)
    a, b = np.concatenate([make(17), core, make(30)]), np.concatenate([make(44), core, make(9)])
    for level in [*levels(a, np.array([0, len(a)])), *levels(b, np.array([0, len(b)]))]:
        assert (np.diff(level.left) >= 0).all() and (np.diff(level.right) >= 0).all()
    both = levels(np.concatenate([a, b]), np.array([0, len(a), len(a), len(a) + len(b)]))
    assert all((np.diff(x.left) >= 0).all() and (np.diff(x.right) >= 0).all() for x in both)
    for width in (5, 12, 35):
        (at1, name1), (at2, name2) = (look(number) for number, look in (anchors(x, np.array([0, len(x)]), width) for x in (a, b)))
        k = len(core) - width + 1
        assert (at1[17 : 17 + k] - 17 == at2[44 : 44 + k] - 44).all() and (name1[17 : 17 + k] == name2[44 : 44 + k]).all()


@pytest.mark.parametrize("dense", [4096, 1])
def test_recompression_matches_brute_force(spark, monkeypatch, dense):
    import lodestone.llm.repeats as repeats

    monkeypatch.setattr(repeats, "DENSE", dense)

    texts = [*sample_texts(11, [*WORDS, *(f"w{i}" for i in range(40))]), "na " * 90, "na " * 50 + "batman", "a b " * 60, "a b " * 60 + "c"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "y"), (5, texts[5], "z")], "doc_id long, text string, n string")
    got = sorted((tuple(r) for r in recompression_dedup(docs, 35).collect()), key=str)
    ids = [*range(len(texts)), None, 5]
    want = sorted(((i, *x) for i, x in zip(ids, brute_words([*texts, "", texts[5]], 35))), key=str)
    assert got == want
    assert recompression_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("names", [1, 2, 1 << 62])
def test_windows_of_equal_names_are_told_apart_by_their_words(monkeypatch, names):
    import pyarrow as pa

    import lodestone.llm.recompression as recompression

    real = recompression.gram_hashes
    monkeypatch.setattr(recompression, "gram_hashes", lambda sums, size: real(sums, size) % np.uint64(names))
    rng = np.random.default_rng(names % 97)
    records = [" ".join(rng.choice(["a", "b", "cc", "é"], rng.integers(3, 12))) for _ in range(120)]
    records = [r if i % 3 else r.replace(" ", "\n  ") for i, r in enumerate(records)]
    h, off = np.sort(rng.integers(0, 9, 120)), rng.integers(-1, 3, 120)
    width, seen = 3, {}
    for i, r in enumerate(records):
        w = r.split()
        for k in range(len(w) - width + 1):
            seen.setdefault((h[i], k - off[i], tuple(w[k : k + width])), []).append((i, k - off[i]))
    want = sorted(x for own in seen.values() if len(own) > 1 for x in own)
    record, place = recompression.repeated_windows(h, off, pa.array([r.encode() for r in records], pa.binary()), width)
    assert sorted(zip(record.tolist(), place.tolist())) == want


@pytest.mark.parametrize("apply, brute, width", [(suffix_dedup, lambda t: brute_bytes([x.encode() for x in t], 200), 200), (recompression_dedup, lambda t: brute_words(t, 35), 35)])
def test_a_record_many_times_in_a_text(spark, apply, brute, width):
    """A passage often in one text and nowhere else, one shared by many texts, and texts of one period."""
    rng = np.random.default_rng(3)
    make = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 500, n))
    own, shared = make(90), make(90)
    texts = [" ".join([own, make(20)] * 7), *(" ".join([make(15), shared, make(15)] * int(rng.integers(1, 4))) for _ in range(20)), "la " * 900, "la " * 100, make(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in apply(docs, width).collect())
    assert got == [(i, *x) for i, x in enumerate(brute(texts))]


@pytest.mark.parametrize("apply", [suffix_dedup, recompression_dedup])
def test_anchors_and_records_are_shuffled_once(spark, apply):
    docs = spark.createDataFrame([(i, f"{i % 3} " * 300) for i in range(9)], "doc_id long, text string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = apply(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for scan in ("places", "records", "picked"):
        assert plan.count(f"MapInArrow {scan}(") == 1, scan
