import numpy as np
import pyarrow as pa

import hashlib

from lodestone.llm.fm_decontaminate import WORD, FMIndex, Phrases, contamination, decontaminate, find, item_parts, lower_ascii, without
from lodestone.llm.rolling import first_minimum, prefix_sums, slice_hash


def brute(items, text, width):
    words = WORD.findall(lower_ascii(text))
    hit, found = set(), set()
    for item, t in items:
        w = WORD.findall(lower_ascii(t))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            x = w[i : i + width]
            for j in range(len(words) - len(x) + 1):
                if words[j : j + len(x)] == x:
                    hit |= {*range(j, j + len(x))}
                    found.add(item)
    return len(words), hit, found


def test_index_counts_and_locates():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 3000)
    index = FMIndex(text)
    phrases = rng.integers(0, 5, (200, 4))
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(text) - 3) if (text[i : i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_find_matches_brute_force():
    rng = np.random.default_rng(2)
    letters = ["a", "B", "é", "7", "zz"]
    make = lambda n: "".join(letters[i] + " .-\n"[rng.integers(4)] for i in rng.integers(0, 5, n))
    items = [("i1", make(9)), ("i2", make(3)), ("i3", ""), ("i4", make(6)), ("i4", make(5))]
    texts = [make(n) for n in (0, 1, 4, 50, 300, 300)] + ["", "abc", "a", "b", items[0][1], items[0][1] * 2]
    for width in (3, 4, 10):
        counts, spans, found = find(Phrases(items, width), pa.array(texts))
        for i, text in enumerate(texts):
            n, hit, names = brute(items, text, width)
            own = {w for a, b in zip(spans.get(i, [])[::2], spans.get(i, [])[1::2]) for w in range(a, b)}
            assert (counts[i], own, found.get(i, set())) == (n, hit, names)


def test_item_parts_keep_every_window(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in rng.integers(0, 50, 200)]
    bench = spark.createDataFrame([("a", " ".join(words)), ("b", "x y"), ("c", ""), ("d", None), (None, "q")], "item_id string, text string")
    rows = item_parts(bench, 10, part_words=30).collect()
    windows = {tuple(w[i : i + 10]) for r in rows if r["item"] == "a" for w in [r["text"].split()] for i in range(len(w) - 9)}
    assert windows == {tuple(words[i : i + 10]) for i in range(191)}
    assert sorted(r["item"] for r in rows if r["item"] != "a") == ["b"]


def test_one_block_or_many_give_the_brute_force_result(spark):
    rng = np.random.default_rng(5)
    make = lambda n: " ".join(f"W{i}" for i in rng.integers(0, 6, n))
    items = [(f"i{k}", make(int(rng.integers(1, 9)))) for k in range(12)] + [("i1", make(5)), ("none", "-- "), ("null", None)]
    texts = [make(int(n)) for n in rng.integers(0, 60, 30)] + [None, "", "W1", make(40)]
    texts.append(texts[3])
    docs = spark.createDataFrame([(i, t, 1, "a", None, i) for i, t in enumerate(texts)], "doc_id long, text string, _hits int, _words string, `_items` string, `n.x` int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (1 << 20, 200):
        got = {r["doc_id"]: r for r in contamination(docs, bench, width=3, block_bytes=block).collect()}
        for i, t in enumerate(texts):
            n, hit, names = brute([x for x in items if x[1]], t or "", 3)
            want = (n, len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"], got[i]["contaminated"]) == want
        cut = decontaminate(docs, bench, width=3, block_bytes=block)
        assert cut.columns == docs.columns
        cut = {r["doc_id"]: r["text"] for r in cut.collect()}
        for i, t in enumerate(texts):
            n, hit, _ = brute([x for x in items if x[1]], t or "", 3)
            words = WORD.findall(t or "")
            assert WORD.findall(cut[i] or "") == [w for k, w in enumerate(words) if k not in hit] and (cut[i] is None) == (t is None)
    assert contamination(docs.limit(0), bench).count() == 0
    assert contamination(docs, bench.limit(0)).where("n_hit > 0 or n_items > 0").count() == 0


def test_without_cuts_whole_spans():
    assert without("One two, three four.", [(1, 3)]) == "One four."
    assert without("One two", [(0, 2)]) == ""


def test_rolling():
    v = np.random.default_rng(3).integers(0, 3, 400).astype(np.uint64) << np.uint64(40)
    got = first_minimum(v, 7)
    assert got.tolist() == [i + int(np.argmin(v[i : i + 7])) for i in range(394)]
    s = prefix_sums(v)
    keys = slice_hash(s, np.arange(390), np.arange(390) + 9)
    for i in range(0, 390, 37):
        assert [k == keys[i] for k in keys] == [(v[j : j + 9] == v[i : i + 9]).all() for j in range(390)]
