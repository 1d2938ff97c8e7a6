import zlib
from itertools import product

import numpy as np
import pyarrow.parquet as pq

from lodestone.llm.language_crf import UND, Field, accepted, fit, forward_backward, identify, learn, placed, predict, scores, word_features

LANGUAGES = {"aa": ["thing", "other", "under", "shore"], "bb": ["ça", "été", "leçon", "naître"], "cc": ["groß", "über", "nicht", "zwei"]}


def sentences(n, seed=1, low=8, high=120):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = list(LANGUAGES)[i % 3]
        out.append((lang, " ".join(LANGUAGES[lang][j] + "xyz"[rng.integers(3)] for j in rng.integers(0, 4, rng.integers(low, high)))))
    return out


def trained():
    own = sentences(120)
    return fit(list(LANGUAGES), [t for _, t in own], [list(LANGUAGES).index(g) for g, _ in own])


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    k = 3
    field = Field(["a", "b", "c"], np.zeros((4 << 16, k), np.float32), rng.standard_normal((k, k)).astype(np.float32), rng.standard_normal(k).astype(np.float32))
    sizes = np.array([1, 4, 6, 2])
    first = np.cumsum(sizes) - sizes
    emit = rng.standard_normal((sizes.sum(), k)).astype(np.float32)
    e, mask = placed(emit, first, sizes)
    post, pairs, begin = forward_backward(field, e, mask)
    all_pairs, all_begin = np.zeros((k, k)), np.zeros(k)
    for c, (a, n) in enumerate(zip(first, sizes)):
        paths = list(product(range(k), repeat=int(n)))
        score = np.array([field.start[p[0]] + sum(emit[a + t, p[t]] for t in range(n)) + sum(field.moves[x, y] for x, y in zip(p, p[1:])) for p in paths])
        weight = np.exp(score - score.max())
        weight /= weight.sum()
        want = np.zeros((n, k))
        for p, w in zip(paths, weight):
            want[np.arange(n), p] += w
            for x, y in zip(p, p[1:]):
                all_pairs[x, y] += w
            all_begin[p[0]] += w
        assert np.allclose(post[:n, c], want, atol=1e-4) and mask[:, c].sum() == n
    assert np.allclose(pairs, all_pairs, atol=1e-3) and np.allclose(begin, all_begin, atol=1e-4)


def test_long_texts_are_one_chain():
    field = trained()
    rng = np.random.default_rng(3)
    field.moves = (rng.standard_normal(field.moves.shape) * 2).astype(np.float32)
    texts = [t for _, t in sentences(4, 5, 130, 400)] + ["thingx", "", "123"]
    grams, low, high, words, before = word_features(texts)
    emit = scores(field, grams, low, high, words)
    size = np.diff(before)
    some = np.flatnonzero(size)
    e, mask = placed(emit, before[some], size[some])
    post, _, _ = forward_backward(field, e, mask)
    whole = (post * mask[:, :, None]).sum(axis=0, dtype=np.float64)
    labels, shares = predict(field, texts)
    for c, i in enumerate(some):
        assert labels[i] == field.labels[whole[c].argmax()]
        assert abs(shares[i] - whole[c].max() / whole[c].sum()) < 1e-4
    assert labels[-2:] == [UND, UND] and shares[-2:] == [0, 0]


def test_code_switches_and_held_out_texts():
    field = trained()
    held = sentences(90, 9)
    labels, shares = predict(field, [t for _, t in held])
    assert sum(a == g for a, (g, _) in zip(labels, held)) >= 88 and all(0 <= s <= 1 for s in shares)
    (a, t), (b, u) = held[0], held[1]
    mixed = " ".join([*t.split()[:20], *u.split()[:10]]) if len(t.split()) >= 20 and len(u.split()) >= 10 else t
    (label,), (share,) = predict(field, [mixed])
    assert label == a and share < 1


def test_ties_and_no_model():
    assert predict(None, ["abc", ""]) == ([UND, UND], [0.0, 0.0])
    flat = Field(["b", "c"], np.zeros((4 << 16, 2), np.float32), np.zeros((2, 2), np.float32), np.zeros(2, np.float32))
    assert predict(flat, ["some words"]) == (["b"], [0.5])


def test_rows(spark):
    own = sentences(240, 4)
    rows = [(i, t, g, 0.1, "x") for i, (g, t) in enumerate(own)] + [(None, own[0][1], "aa", 0.2, None), (900, None, "aa", None, "y"), (901, "", None, None, "y"), (902, "12 34 --", None, None, "y"), (3, own[3][1], own[3][0], 0.1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, `lang.pred` string")
    got = identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert (r["lang_pred"] == UND) == (r["doc_id"] in (900, 901, 902))
    right = [(r["lang_pred"], own[r["doc_id"]][0]) for r in got if r["held_out"] and r["doc_id"] < 900]
    assert sum(a == b for a, b in right) / len(right) > 0.95
    kept = accepted(docs)
    assert kept.columns == docs.columns and kept.where("doc_id >= 900").count() == 0 and kept.count() == len(rows) - 3
    assert identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("1 = 1")).collect()} <= {UND, ""}
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in identify(unlabelled).collect()] == [UND]


def test_languages_are_bounded(spark):
    own = sentences(120, 6)
    docs = spark.createDataFrame([(4 * i, t, g) for i, (g, t) in enumerate(own)] + [(10_000 + i, "junk text", f"dirty{i}") for i in range(30)], "doc_id long, text string, lang string")
    assert learn(docs, languages=3).labels == sorted(LANGUAGES)


def test_held_out_accuracy_on_documents():
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    table = [r for r in table if r["lang"] and r["text"]]
    labels = sorted({r["lang"] for r in table})
    held = [r for r in table if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    known = [r for r in table if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    field = fit(labels, [r["text"] for r in known][:400], [labels.index(r["lang"]) for r in known][:400])
    found, _ = predict(field, [r["text"] for r in held])
    named = [(a, r["lang"]) for a, r in zip(found, held) if a != UND]
    assert len(named) > 100 and sum(a == b for a, b in named) / len(named) >= 0.98
