import numpy as np
import xxhash

from lodestone.llm.simhash import allocate, fingerprints_of, links, masks, near_duplicates, parts_of


def slow_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    texts = ["", " \n", "One", "one TWO", "a b c", "a b c a b c a b c d É é", "x\x0by z w"]
    assert fingerprints_of(texts).tolist() == [slow_fingerprint(t) for t in texts]


def brute(values, tau):
    return {(a, b) for a in values for b in values if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= tau}


def test_links_cover_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64)
    values = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(4):
            x = b & (1 << 64) - 1
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(bit)
            values.add(x - (1 << 64) if x >> 63 else x)
    fps = spark.createDataFrame([(v,) for v in sorted(values)], "fp long")
    from lodestone.llm.components import components

    for dense in (64, 1):
        for tau in (2, 1):
            got = {(min(r), max(r)) for r in links(fps, tau, dense).collect()}
            want = brute(values, tau)
            assert got <= brute(values, 2) if tau == 2 else got <= want
            if dense == 64:
                assert got == want
            root = {r["node"]: r["root"] for r in components(links(fps, tau, dense)).collect()}
            assert all(root[a] == root[b] for a, b in want) and set(root) == {x for p in want for x in p}


def test_thresholds_sum():
    fps = np.random.default_rng(5).integers(0, 1 << 63, 500, dtype=np.int64).view(np.uint64)
    counts = np.random.default_rng(6).integers(100, 300, (64, 64))
    for m in (2, 3):
        parts = parts_of((counts + counts.T) / 2, 1000, m)
        assert sorted(b for p in parts for b in p) == list(range(64)) and len(masks(parts)) == m
        chosen, _ = allocate(fps, parts, np.random.default_rng(7).integers(0, 9, (m, 1 << 16)), 2)
        assert (chosen.sum(axis=1) == 2 - m + 1).all()


def test_near_duplicates_edges(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(5, text, 1), (3, text, 2), (None, text, 3), (7, None, 4), (6, "", 5), (9, "other words here now", 6), (9, "other words here now", 6), (None, "lone text of its own", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in near_duplicates(docs).collect())
    assert got == sorted([("5", "3"), ("3", "3"), ("None", "3"), ("7", "6"), ("6", "6"), ("9", "9"), ("9", "9"), ("None", "None")])
    assert near_duplicates(docs.limit(0)).count() == 0
